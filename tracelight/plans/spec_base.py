"""Declared kinds of specifications: a name and a table of parameters, each with its default and its limits.

An instance is data: immutable, compared by value, JSON in and out, identified by a digest. Where a kind is
bound to an operator, ``run`` calls it with the parameters under the operator's own names."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

REQUIRED = object()


@dataclass(frozen=True)
class P:
    """One parameter. Numbers lie ``above`` / at ``least`` / ``below`` / at ``most``; ``among`` lists the values there are.

    ``to`` is the operator's name for it; ``samples`` turns seconds into samples of the clock that ``run`` is told.
    ``only`` marks a parameter of which this engine knows the default alone. None passes where it is the default."""

    default: object = REQUIRED
    above: float | None = None
    least: float | None = None
    below: float | None = None
    most: float | None = None
    among: tuple | None = None
    kind: type | tuple | None = None
    to: str | None = None
    samples: bool = False
    only: bool = False

    def problem(self, value) -> str | None:
        if value is None and self.default is None:
            return None
        if self.only and value != self.default:
            return f"can only be {self.default!r} here"
        if self.among is not None and value not in self.among:
            return f"is none of {', '.join(map(str, self.among))}"
        if self.kind is not None and not isinstance(value, self.kind):
            return f"is no {getattr(self.kind, '__name__', self.kind)}"
        limits = ((self.above, lambda v, x: v > x, "above"), (self.least, lambda v, x: v >= x, "at least"), (self.below, lambda v, x: v < x, "below"), (self.most, lambda v, x: v <= x, "at most"))
        for limit, holds, words in limits:
            if limit is not None and not all(isinstance(v, (int, float)) and holds(v, limit) for v in (value if isinstance(value, tuple) else (value,))):
                return f"is not {words} {limit:g}"
        return None


SPECS: dict[str, type[Spec]] = {}


def _frozen(value):
    return tuple(_frozen(v) for v in value) if isinstance(value, (list, tuple)) else frozenset(value) if isinstance(value, (set, frozenset)) else value


def _plain(value):
    if isinstance(value, Spec):
        return value.to_dict()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, frozenset):
        return sorted((_plain(v) for v in value), key=repr)
    return [_plain(v) for v in value] if isinstance(value, tuple) else value


def from_dict(raw):
    """What ``to_dict`` gave, as specifications again; unknown kinds and parameters are refused."""
    if isinstance(raw, list):
        return tuple(from_dict(x) for x in raw)
    if not isinstance(raw, dict) or "spec" not in raw:
        return raw
    if raw["spec"] not in SPECS:
        raise ValueError(f"unknown specification {raw['spec']!r}")
    return SPECS[raw["spec"]](**{k: from_dict(v) for k, v in raw.items() if k != "spec"})


class Spec:
    TABLE: dict[str, P] = {}
    RULES: tuple[tuple[str, Callable], ...] = ()
    OPERATOR: str | Callable | None = None

    def __init__(self, *values, **named):
        if len(values) > len(self.TABLE):
            raise TypeError(f"{type(self).__name__} has {len(self.TABLE)} parameters")
        given = dict(zip(self.TABLE, values))
        if unknown := (set(named) - set(self.TABLE)) | (set(named) & set(given)):
            raise TypeError(f"{type(self).__name__}: unknown or repeated {sorted(unknown)}")
        given |= named
        if missing := [k for k, p in self.TABLE.items() if p.default is REQUIRED and k not in given]:
            raise TypeError(f"{type(self).__name__} needs {missing}")
        found = {k: _frozen(given.get(k, p.default)) for k, p in self.TABLE.items()}
        if wrong := [f"{k} {said}" for k, p in self.TABLE.items() if (said := p.problem(found[k]))]:
            raise ValueError(f"{type(self).__name__}: " + "; ".join(wrong))
        object.__setattr__(self, "values", found)
        if wrong := [said for said, holds in self.RULES if not holds(self)]:
            raise ValueError(f"{type(self).__name__}: " + "; ".join(wrong))

    def __getattr__(self, name):
        values = self.__dict__.get("values", {})
        if name in values:
            return values[name]
        raise AttributeError(f"{type(self).__name__} has no {name}")

    def __setattr__(self, name, value):
        raise AttributeError(f"{type(self).__name__} does not change; replace() gives another")

    def __reduce__(self):
        return from_dict, (self.to_dict(),)

    def __eq__(self, other):
        return type(self) is type(other) and self.values == other.values

    def __hash__(self):
        return hash(self.canonical())

    def __repr__(self):
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.values.items())})"

    def replace(self, **changes):
        return type(self)(**{**self.values, **changes})

    def to_dict(self) -> dict:
        return {"spec": type(self).__name__, **{k: _plain(v) for k, v in self.values.items()}}

    def canonical(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    def fingerprint(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()

    def arguments(self, rate_hz: float | None = None) -> dict:
        """Operator arguments by their names, those of nested specifications included."""
        out = {}
        for name, p in self.TABLE.items():
            value = self.values[name]
            if isinstance(value, Spec):
                out |= value.arguments(rate_hz)
            elif p.to is not None:
                if p.samples:
                    if rate_hz is None:
                        raise ValueError(f"{name} is in seconds: run() needs rate_hz")
                    value = max(1, round(value * rate_hz))
                out[p.to] = value
        return out

    def run(self, *tables, rate_hz: float | None = None, **more):
        """The operator of this kind on ``tables``; ``more`` are arguments that are no part of the specification."""
        if self.OPERATOR is None:
            raise TypeError(f"{type(self).__name__} is a part of others and runs nothing itself")
        if callable(bound := type(self).__dict__["OPERATOR"]):
            return bound(self, *tables, **({} if rate_hz is None else {"rate_hz": rate_hz}), **more)
        module, name = bound.split(":")
        function = getattr(import_module(f"tracelight.operators.{module}"), name)
        known = inspect.signature(function).parameters
        given = {k: v for k, v in self.arguments(rate_hz).items() if k in known}
        if rate_hz is not None and "rate_hz" in known:
            given["rate_hz"] = rate_hz
        return function(*tables, **given, **more)


def declare(kind: str, operator: str | Callable | None = None, rules: tuple = (), **table: P) -> type[Spec]:
    made = SPECS[kind] = type(kind, (Spec,), {"TABLE": table, "RULES": rules, "OPERATOR": operator, "__module__": __name__})
    return made
