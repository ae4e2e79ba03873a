"""External induced suffix sorting: suffixes and common-prefix values in order, by two sweeps over queues.

S* suffixes (those that start an ascent after a descent) are named by their substrings, and the
string of names is ordered by doubling. Two induction sweeps then take suffixes from queues in order:
each suffix taken puts the one that starts a byte earlier into that byte's queue. As suffixes are
taken in order, each byte's queue is filled in order, so the queues together are the priority queue
of (byte, order of the rest). An entry carries its position and the prefix it has in common with the
entry before it, capped at ``depth``: one more than the least value among the entries between the
two that put them there. Queues beyond ``memory`` bytes go to an unlinked scratch file of the task."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 17


class Scratch:
    """Blocks of (positions, prefixes), kept in memory up to a budget and on disk beyond it."""

    def __init__(self, memory: int):
        self.memory, self.used, self.file = memory, 0, None

    def put(self, pos: np.ndarray, lcp: np.ndarray):
        size = pos.nbytes + lcp.nbytes
        if self.used + size <= self.memory:
            self.used += size
            return pos, lcp
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(pos.tobytes())
        self.file.write(lcp.tobytes())
        return at, len(pos), pos.dtype

    def get(self, kept) -> tuple[np.ndarray, np.ndarray]:
        if len(kept) == 2:
            self.used -= kept[0].nbytes + kept[1].nbytes
            return kept
        at, n, kind = kept
        self.file.seek(at)
        raw = self.file.read(n * (kind.itemsize + 1))
        return np.frombuffer(raw, kind, n), np.frombuffer(raw, np.uint8, n, n * kind.itemsize)

    def merged(self, queue: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What a queue holds and still gets while it is read, in blocks of BLOCK entries or what there is."""
        done = 0
        while done < len(queue):
            parts, size = [], 0
            while done < len(queue) and size < BLOCK:
                parts.append(self.get(queue[done]))
                queue[done] = None
                size += len(parts[-1][0])
                done += 1
            yield (parts[0] if len(parts) == 1 else (np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of keys, equal for equal keys; how many there are."""
    order = np.argsort(keys)
    own = keys[order]
    step = np.empty(len(own), np.int64)
    step[0] = 0
    np.not_equal(own[1:], own[:-1], out=step[1:], casting="unsafe")
    np.cumsum(step, out=step)
    rank = np.empty(len(own), np.int64)
    rank[order] = step
    return rank, int(step[-1]) + 1


class InducedSort:
    """Orders the suffixes of ``text`` (unsigned 16-bit, 0 ends each string, the last symbol is 0) by their first ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int, memory: int = 256 << 20):
        self.t, self.depth, self.scratch = text, depth, Scratch(memory)
        self.kind = np.int32 if len(text) < 1 << 31 else np.int64
        n = len(text)
        rises = np.full(n, -1, np.int8)
        rises[:-1] = np.where(text[:-1] < text[1:], 1, np.where(text[:-1] > text[1:], 0, -1))
        rises[-1] = 1
        # a plateau is of the type of the symbol that ends it
        known = np.where(rises >= 0, np.arange(n), n)
        known = np.minimum.accumulate(known[::-1])[::-1]
        self.small = rises[known] == 1
        self.stars = np.flatnonzero(self.small[1:] & ~self.small[:-1]).astype(self.kind) + 1
        self.symbols = int(text.max()) + 1

    def _names(self) -> np.ndarray:
        """Ranks of the S* substrings, in text order: symbols with their type, four to a word."""
        t, stars = self.t, self.stars
        typed = np.zeros(len(t) + 4, np.uint64)
        typed[: len(t)] = t.astype(np.uint64) * np.uint64(2) + self.small
        ends = np.append(stars[1:], len(t) - 1).astype(np.int64)
        left = ends - stars + 1  # symbols of the substring not yet looked at
        at, rank, todo = stars.astype(np.int64), np.zeros(len(stars), np.int64), np.arange(len(stars))
        while len(todo):
            word = np.zeros(len(todo), np.uint64)
            for k in range(4):
                symbol = np.where(left[todo] > k, typed[np.minimum(at[todo] + k, len(typed) - 1)] + np.uint64(1), np.uint64(0))
                word = (word << np.uint64(12)) | symbol
            # everyone with this rank so far is ordered by the word; those that are over keep word 0
            keys = np.zeros(len(stars), np.uint64)
            keys[todo] = word
            rank, _ = _dense(_pair(rank, keys))
            at[todo] += 4
            left[todo] -= 4
            todo = todo[left[todo] > 0]
        return rank

    def _star_order(self) -> tuple[np.ndarray, np.ndarray]:
        """S* positions in order, and the prefix each has in common with the one before."""
        rank = self._names()
        count, span = int(rank.max()) + 1 if len(rank) else 0, 1
        while 2 * span < self.depth and count < len(rank):  # S* are two apart at least: 2 * span symbols are ordered
            after = np.zeros(len(rank), np.int64)
            after[:-span] = rank[span:] + 1
            rank, count = _dense(rank * (count + 1) + after)
            span *= 2
        order = np.argsort(rank, kind="stable")
        pos = self.stars[order]
        lcp = np.zeros(len(pos), np.uint8)
        if len(pos) > 1:
            lcp[1:] = self._common(pos[:-1], pos[1:])
        return pos, lcp

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols in common from each a and b on, up to depth."""
        t, last = self.t, len(self.t) - 1
        out, todo = np.zeros(len(a), np.uint8), np.arange(len(a))
        for k in range(self.depth):
            x, y = t[np.minimum(a[todo] + k, last)], t[np.minimum(b[todo] + k, last)]
            todo = todo[(x == y) & (np.maximum(a[todo], b[todo]) + k <= last)]
            if not len(todo):
                break
            out[todo] = k + 1
        return out

    def order(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (positions, prefix in common with the suffix given before), from the largest suffix to the smallest."""
        stars, star_lcp = self._star_order()
        bounds = np.searchsorted(self.t[stars], np.arange(self.symbols + 1))
        queues: list[list] = [[] for _ in range(self.symbols)]
        large: list[list] = [[] for _ in range(self.symbols)]
        sweep = _Sweep(self, queues, rising=True)
        for c in range(self.symbols):
            sweep.bucket()
            for pos, lcp in self.scratch.merged(queues[c]):  # the queue grows by suffixes that repeat c
                sweep.take(pos, lcp)
                large[c].append(self.scratch.put(pos, lcp))
            queues[c] = []
            s, e = bounds[c], bounds[c + 1]
            if e > s:
                lcp = star_lcp[s:e].copy()
                lcp[0] = self._common(sweep.last[None], stars[s : s + 1])[0] if large[c] else 0
                for at in range(0, e - s, BLOCK):
                    sweep.take(stars[s + at : min(e, s + at + BLOCK)], lcp[at : at + BLOCK])
        del stars, star_lcp
        small: list[list] = [[] for _ in range(self.symbols)]
        sweep = _Sweep(self, small, rising=False)
        for c in range(self.symbols - 1, -1, -1):
            sweep.bucket()
            above = None
            for pos, lcp in self.scratch.merged(small[c]):
                sweep.take(pos, lcp)
                yield pos, lcp
                above = sweep.last
            small[c] = []
            carried = None  # the prefix an entry has in common with the larger one after it
            for kept in reversed(large[c]):
                pos, lcp = self.scratch.get(kept)
                pos = pos[::-1]
                down = np.empty(len(lcp), np.uint8)
                down[1:] = lcp[:0:-1]
                down[0] = carried if carried is not None else (self._common(above[None], pos[:1])[0] if above is not None else 0)
                carried = lcp[0]
                sweep.take(pos, down)
                yield pos, down
            large[c] = []
        self.scratch.close()


class _Sweep:
    """One induction sweep: takes blocks in order and fills the queues of the bytes before."""

    def __init__(self, sort: InducedSort, queues: list[list], rising: bool):
        self.sort, self.queues, self.rising = sort, queues, rising
        self.since = np.full(sort.symbols, 255, np.uint8)  # least prefix taken since the last entry of each queue
        self.begun = np.zeros(sort.symbols, bool)
        self.last = None

    def bucket(self) -> None:
        """Suffixes taken from now on start with another symbol than those before."""
        self.since[:] = 0

    def take(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if not len(pos):
            return
        for at in range(0, len(pos), BLOCK):
            self._take(pos[at : at + BLOCK], lcp[at : at + BLOCK])
        self.last = pos[-1]

    def _take(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        sort, t = self.sort, self.sort.t
        before = pos - 1
        fits = (pos > 0) & (sort.small[before] != self.rising)
        at = np.flatnonzero(fits)
        low = np.minimum.accumulate(lcp)
        if not len(at):
            np.minimum(self.since, low[-1], out=self.since)
            return
        symbol = t[before[at]]
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        starts = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        heads = symbol[starts]
        value = np.empty(len(at), np.uint8)
        inner = np.ones(len(at), bool)
        inner[starts] = False
        value[inner] = _range_min(lcp, at[np.flatnonzero(inner) - 1] + 1, at[inner])
        value[starts] = np.minimum(self.since[heads], low[at[starts]])
        value = np.minimum(value, sort.depth - 1) + 1
        value[starts[~self.begun[heads]]] = 0
        self.begun[heads] = True
        np.minimum(self.since, low[-1], out=self.since)
        stops = np.append(starts[1:], len(at))
        tail = np.minimum.accumulate(lcp[::-1])[::-1]
        after = at[stops - 1] + 1
        self.since[heads] = np.where(after < len(lcp), tail[np.minimum(after, len(lcp) - 1)], 255)
        found = before[at]
        for c, s, e in zip(heads.tolist(), starts.tolist(), stops.tolist()):
            self.queues[c].append(sort.scratch.put(found[s:e], value[s:e]))


def _pair(rank: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One key per (rank, word): words are made dense first, so both fit a word."""
    dense, count = _dense(word)
    return rank * count + dense


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least value from each first to each last, ends included."""
    if not len(first):
        return np.zeros(0, values.dtype)
    width = last - first + 1
    level = np.frexp(width)[1] - 1
    out, row, k = np.empty(len(first), values.dtype), values, 0
    top = int(level.max())
    while True:
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(row[first[own]], row[last[own] - (1 << k) + 1])
        if k == top:
            return out
        row = np.minimum(row[: len(row) - (1 << k)], row[1 << k :])
        k += 1
