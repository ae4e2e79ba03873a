"""Tokenizer caches shared by the token operators: exact ids per chunk, exact counts per prefix."""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

import numpy as np
import regex

#: Entries a worker's cache may hold before it starts afresh.
CACHE_ENTRIES = 500_000
#: Longer pieces are computed anew each time rather than kept.
CACHE_CHARS = 48

# White space as Unicode's White_Space has it, and the pretokenizer patterns of the two vocabularies.
SPACE = r"\t-\r \x85\xa0  -     　"
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Bytes of texts whose pretokens are told apart without a pattern: lower-case letters (those of Latin-1 in
#: UTF-8 too), ASCII white space, stops and commas.
_PLAIN = bytes([*range(97, 123), 32, 9, 10, 11, 12, 13, 46, 44, 0xC3, *range(0x80, 0xC0)])
_NOT_PLAIN = (b"..", b".,", b",.", b",,", b"\xc3\x97", b"\xc3\xb7")


def plain_words(text: bytes) -> list[bytes] | None:
    """The pretokens of a plain text, ASCII in lower case: words, and stops and commas that stand alone; else None."""
    text = text.lower()
    if text.translate(None, _PLAIN) or any(x in text for x in _NOT_PLAIN):
        return None
    return text.replace(b".", b" . ").replace(b",", b" , ").split()


class _Learned(dict):
    """A cache that learns what it is asked for and lacks."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, key):
        found = self[key] = self.learn(key)
        return found


class _Kept(_Learned):
    """One that keeps short keys alone, and starts afresh when it is full."""

    def __init__(self, learn, entries: int):
        super().__init__(learn)
        self.entries = entries

    def __missing__(self, key):
        found = self.learn(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.entries:
                self.clear()
            self[key] = found
        return found


class ChunkIds:
    """Ids of whole texts from a word BPE that drops white space, by a cache of white-space-free chunks.

    White space always ends a pretoken and is dropped, and special strings hold none, so the ids of
    a text are its chunks' ids put together. Unseen chunks are cut to pretokens, and the library's
    model gives the ids of unseen pretokens, written in the byte alphabet."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.lib = _library(path)
        self.model, self.normal = self.lib.model, self.lib.normalizer.normalize_str
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.shown = {b: c for c, b in _byte_alphabet().items()}
        self.find = regex.compile(WORD_PATTERN).findall
        self.entries, self.chunks, self.words = entries, _Learned(self._chunk), _Learned(self._word)

    def _word(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(self.shown)
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, raw: bytes) -> bytes:
        if raw.isalpha():
            return self._word(raw.lower().decode())
        text = raw.decode("utf-8", "replace")
        if "<|" in text and any(s in text for s in self.special):
            ids = self.lib.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        # below U+0100 the normal form is the text itself in lower case
        pieces = self.find(text.lower() if text.isascii() or max(text) < "\u0100" else self.normal(text))
        if len(pieces) == 1:
            return self._word(pieces[0])
        return b"".join([self.words[p] for p in pieces])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        for kept in (self.chunks, self.words):
            if len(kept) > self.entries:
                kept.clear()
        get, out = self.chunks.__getitem__, []
        for text in texts:
            words = plain_words(text)
            out.append(b"".join(map(get, text.split() if words is None else words)))
        return out


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself where it is printable, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def _bytes(steps: list[int]) -> bytes:
    """Steps as signed bytes; a step that is none is an error rather than another number."""
    if steps and (max(steps) > 127 or min(steps) < -128):
        raise OverflowError("a token count changes by more than a signed byte from one character to the next")
    return bytes([x & 255 for x in steps])


class PrefixCounts:
    """Exact token counts at every character prefix of a text, by dynamic programming over byte prefixes.

    Within a pretoken, the encoding of a prefix ends in the one vocabulary entry that may follow the
    last token of what stands before it; two tokens may stand side by side when the library encodes
    their joined bytes as just these two. An Aho-Corasick automaton lists the entries that end at
    each byte, so ``count[end] = count[start] + 1`` fills the table from left to right."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        import ahocorasick

        self.lib = _library(path)
        alphabet = _byte_alphabet()
        self.to_shown = {b: c for c, b in alphabet.items()}
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        special = set(self.special)
        self.text_of, self.trie = {}, ahocorasick.Automaton()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        for shown, token in vocab.items():
            if shown not in special:
                raw = "".join([chr(alphabet[c]) for c in shown])
                self.text_of[token] = shown
                self.trie.add_word(raw, (token, len(raw)))
        self.trie.make_automaton()
        self.find = regex.compile(BYTE_PATTERN).findall
        self.lines = re.compile(r"(?<=\S)\n(?=\S)").split
        self.split = re.compile(r"(?<=\S) (?=\S)").split
        self.is_space = regex.compile(rf"[{SPACE}]+").fullmatch
        self.entries, self.pairs, self.pretokens, self.units = entries, {}, {}, _Kept(self._stretch, entries)

    def _stand(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before`` (-1: may stand alone) in an encoding."""
        key = (before << 17) + token
        ok = self.pairs.get(key)
        if ok is None:
            want = [token] if before < 0 else [before, token]
            got = [t.id for t in self.lib.model.tokenize("".join(self.text_of[t] for t in want))]
            ok = self.pairs[key] = got == want
            if len(self.pairs) > 4 * self.entries:
                self.pairs = {key: ok}
        return ok

    def _counts(self, raw: str) -> list[int]:
        """Counts of the prefixes of 0, 1, ... bytes, in one pass over the entries that end at each byte."""
        size = len(raw)
        last, count = [-1] * (size + 1), [0] * (size + 1)
        pairs = self.pairs
        for at, (token, length) in self.trie.iter(raw):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - length
            before = last[start]
            if before < 0 and start:
                continue
            ok = pairs.get((before << 17) + token)
            if ok is None:
                ok = self._stand(before, token)
            if ok:
                last[end], count[end] = token, count[start] + 1
        return count

    def pretoken(self, piece: str) -> tuple[bytes, int]:
        """Of one pretoken: signed 8-bit steps of the count over its characters, and the count of all of it."""
        found = self.pretokens.get(piece)
        if found is not None:
            return found
        raw = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        size = len(raw)
        count = self._counts(raw)
        total = count[size]
        if size != len(piece):
            counts, at = [0], 0
            for c in piece:
                at += len(c.encode("utf-8", "surrogatepass"))
                counts.append(count[at])
            count = counts
        found = _bytes([b - a for a, b in zip(count, count[1:])]), total
        if size <= CACHE_CHARS:
            if len(self.pretokens) >= self.entries:
                self.pretokens = {}
            self.pretokens[piece] = found
        return found

    def _total(self, text: str) -> int:
        return sum([self.pretoken(p)[1] for p in self.find(text)])

    def unit(self, text: str) -> bytes:
        """Signed 8-bit steps of the count over the characters of a stretch that no pretoken leaves.

        A cut can change how the last pretokens are told apart: white space before it is one run, and
        a contraction is none yet. Those prefixes are told apart anew."""
        pieces = self.find(text)
        core = text.removeprefix(" ")
        if "'" not in text and (core.split(None, 1) == [core] or not any(map(self.is_space, pieces[:-1]))):
            return b"".join([self.pretoken(p)[0] for p in pieces])
        steps, now, base, before = [], 0, 0, ""
        for piece in pieces:
            own, total = self.pretoken(piece)
            root, lead = (base - self.pretoken(before)[1], before) if before and self.is_space(before) else (base, "")
            if lead or piece in CONTRACTIONS:
                for j in range(1, len(piece) + 1):
                    count = root + self._total(lead + piece[:j])
                    steps.append(count - now)
                    now = count
            else:
                own = [x - 256 if x > 127 else x for x in own]
                steps += [own[0] + base - now, *own[1:]]
                now = base + total
            base += total
            before = piece
        return _bytes(steps)

    def _letters(self, piece: str) -> bytes:
        """Steps of a pretoken of at most CACHE_CHARS letters; so short, no step leaves a byte."""
        if piece.isascii():
            count = self._counts(piece)
        else:
            raw = piece.encode().decode("latin-1")
            count = self._counts(raw)
            count = [0, *[n for n, c in zip(count[1:], raw[1:] + " ") if not "\x80" <= c < "\xc0"]]
        return bytes([(b - a) & 255 for a, b in zip(count, count[1:])])

    def _stretch(self, key: str) -> bytes:
        """Steps of a line feed or, where ``key`` starts with none, a space, and of what follows up to the next. Letters below
        U+0250, alone or before a stop or comma, are told apart without a pattern."""
        fed = key[0] == "\n"
        body = key[1:] if fed else key
        word = body[:-1] if body[-1] in ".," else body
        if len(key) > CACHE_CHARS or not (word.isalpha() and (word.isascii() or max(word) < "\u0250")):
            return self.unit(key if fed else " " + key)
        steps = self.pretoken("\n")[0] + self._letters(word) if fed else self._letters(" " + word) if word is body else self.units[word]
        return steps if word is body else steps + self.pretoken(body[-1])[0]

    def _plain(self, text: str) -> list[bytes]:
        """Steps by stretches. A line feed between two characters that are no white space is a pretoken, whatever stands around it."""
        get, parts = self.units.__getitem__, []
        for k, line in enumerate(self.lines(text)):
            first, *rest = self.split(line)
            if first:
                parts.append(get("\n" + first) if k else self.unit(first))
            parts += map(get, rest)
        return parts

    def steps(self, text: str) -> np.ndarray:
        """Signed steps of the count, one per character; their running sum is the count at every prefix."""
        for mark in self.special:
            if mark in text:
                return self._with_special(text)
        return np.frombuffer(b"".join(self._plain(text)), dtype=np.int8)

    def _with_special(self, text: str) -> np.ndarray:
        marks = regex.compile("|".join(map(regex.escape, self.special)))
        done, start = [], 0
        for m in marks.finditer(text):
            part = text[start : m.end() - 1]
            steps = np.frombuffer(b"".join(self._plain(part)), dtype=np.int8) if part else np.zeros(0, np.int8)
            whole = self._total(text[start : m.start()]) + 1
            done += [steps, np.frombuffer(_bytes([whole - int(steps.sum(dtype=np.int64))]), dtype=np.int8)]
            start = m.end()
        if start < len(text):
            done.append(np.frombuffer(b"".join(self._plain(text[start:])), dtype=np.int8))
        return np.concatenate(done)


@lru_cache(maxsize=2)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)
