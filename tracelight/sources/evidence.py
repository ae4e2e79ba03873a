"""Evidence bundles: JSON and HTML results under a manifest of digests, deterministic archives, comparisons."""

from __future__ import annotations

import hashlib
import html
import json
import math
import os
import zipfile
from pathlib import Path, PurePosixPath

EPOCH = (1980, 1, 1, 0, 0, 0)


def write_atomic(path: Path, data: bytes) -> None:
    """All of it or nothing under the final name."""
    path.parent.mkdir(parents=True, exist_ok=True)
    partial = path.with_name(path.name + ".partial")
    partial.write_bytes(data)
    os.replace(partial, path)


def to_json(value) -> bytes:
    return json.dumps(value, sort_keys=True, indent=1, allow_nan=False, default=str).encode()


def write_manifest(bundle: Path, status: str, **more) -> None:
    """Digests of every file of the bundle and its status: running, complete, blocked or failed."""
    files = {p.relative_to(bundle).as_posix(): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(bundle.rglob("*")) if p.is_file() and p.name != "manifest.json"}
    write_atomic(bundle / "manifest.json", to_json({"status": status, "files": files, **more}))


def _safe(name: str) -> str:
    path = PurePosixPath(name)
    if path.is_absolute() or ".." in path.parts or not path.parts:
        raise ValueError(f"unsafe path {name!r}")
    return name


def read_bundle(bundle: Path) -> dict:
    """The manifest, after every listed file has been found inside the bundle with its digest."""
    manifest = json.loads((bundle / "manifest.json").read_text())
    for name, digest in manifest["files"].items():
        target = bundle / _safe(name)
        if not target.is_file() or target.is_symlink():
            raise ValueError(f"{name} is missing")
        if hashlib.sha256(target.read_bytes()).hexdigest() != digest:
            raise ValueError(f"{name} has changed")
    return manifest


def create_archive(bundle: Path, output: Path, *, overwrite: bool = False) -> str:
    """A ZIP of a verified, complete bundle whose bytes depend on its content alone; returns its digest."""
    manifest = read_bundle(bundle)
    if manifest["status"] != "complete":
        raise ValueError("only a complete bundle is archived")
    if output.exists() and not overwrite:
        raise FileExistsError(output)
    partial = output.with_name(output.name + ".partial")
    with zipfile.ZipFile(partial, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted([*manifest["files"], "manifest.json"]):
            info = zipfile.ZipInfo(name, EPOCH)
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            z.writestr(info, (bundle / name).read_bytes())
    os.replace(partial, output)
    return hashlib.sha256(output.read_bytes()).hexdigest()


def verify_archive(path: Path) -> dict:
    """The manifest of an archive whose members are exactly those it lists, with their digests."""
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        if len(set(names)) != len(names):
            raise ValueError("a member is repeated")
        for name in names:
            _safe(name)
        manifest = json.loads(z.read("manifest.json"))
        if set(names) != {*manifest["files"], "manifest.json"}:
            raise ValueError("members and manifest differ")
        for name, digest in manifest["files"].items():
            if hashlib.sha256(z.read(name)).hexdigest() != digest:
                raise ValueError(f"{name} has changed")
    return manifest


def render_html(title: str, sections: dict[str, list[dict]]) -> str:
    """One self-contained page with a table per section."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><style>body{{font:14px sans-serif}}td,th{{padding:2px 8px;border-bottom:1px solid #ccc}}</style><h1>{html.escape(title)}</h1>"]
    for name, rows in sections.items():
        parts.append(f"<h2>{html.escape(name)}</h2>")
        if not rows:
            parts.append("<p>none</p>")
            continue
        columns = list(rows[0])
        parts.append("<table><tr>" + "".join(f"<th>{html.escape(str(c))}" for c in columns) + "</tr>")
        parts += ["<tr>" + "".join(f"<td>{html.escape(str(r.get(c)))}" for c in columns) + "</tr>" for r in rows]
        parts.append("</table>")
    return "".join(parts)


def compare(left, right, *, absolute: float = 0.0, relative: float = 0.0, ignore=("created_at", "provenance"), most: int = 200, path: str = "") -> list[dict]:
    """Differences of two JSON values, with tolerances for numbers; ``ignore`` names keys that do not count."""
    out: list[dict] = []

    def walk(a, b, at):
        if len(out) >= most:
            return
        if isinstance(a, dict) and isinstance(b, dict):
            for k in sorted({*a, *b} - set(ignore)):
                if k not in a or k not in b:
                    out.append({"path": f"{at}.{k}", "kind": "missing_left" if k not in a else "missing_right"})
                else:
                    walk(a[k], b[k], f"{at}.{k}")
        elif isinstance(a, list) and isinstance(b, list):
            if len(a) != len(b):
                out.append({"path": at, "kind": "length", "left": len(a), "right": len(b)})
            for i, (x, y) in enumerate(zip(a, b)):
                walk(x, y, f"{at}[{i}]")
        elif isinstance(a, bool) or isinstance(b, bool) or not (isinstance(a, int | float) and isinstance(b, int | float)):
            if type(a) is not type(b) or a != b:
                out.append({"path": at, "kind": "value", "left": a, "right": b})
        elif not math.isclose(a, b, rel_tol=relative, abs_tol=absolute):
            out.append({"path": at, "kind": "number", "left": a, "right": b})

    walk(left, right, path)
    return out[:most]
