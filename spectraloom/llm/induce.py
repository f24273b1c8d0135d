"""External induced sorting: suffix array with common-prefix lengths, on disk where needed.

One level of the recursion works on a string of integers that ends in a unique smallest 0:

* A suffix is of kind S if it is smaller than its successor, else of kind L; a leftmost S after
  an L is a seed.  The pieces between seeds are named by rank, and the string of names (at most
  half as long) is sorted by the next level, unless all names differ already; a string of names
  that fits into memory with all it takes is sorted there.
* From the sorted seeds a queue yields all L suffixes: whoever leaves the queue (or the list of
  seeds) pushes its left neighbour, if that is L, with key (symbol, rank of the leaver).  A second
  queue in descending order yields the S suffixes from the L ones.
* Common-prefix lengths travel along.  Two neighbours of one symbol share one symbol more than
  their pushers, which is the least length between the pushers' ranks; an L and an S neighbour
  share as much of their leading run as both have; seeds get theirs from the next level, where
  equal names count with their lengths.

The queue holds sorted runs of tuples and hands them out in batches.  Runs and strings above
``memory`` bytes are mapped files of the task's own scratch folder, the one in which Spark spills.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

SLICE = 1 << 18
BATCH = 1 << 15
BLOCK = 32
INTERNAL_BYTES = 160  # a symbol of a string of names that is sorted in memory


class Scratch:
    """Arrays of one task: in memory up to ``memory`` bytes each, else mapped files."""

    def __init__(self, memory: int = 256 << 20):
        self.memory = memory
        self.files = 0
        self._folder: tempfile.TemporaryDirectory | None = None

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        if self._folder is not None:
            self._folder.cleanup()

    def empty(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.memory:
            return np.empty(n, dtype)
        if self._folder is None:
            spill = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
            self._folder = tempfile.TemporaryDirectory(
                prefix="induce-", dir=spill if spill and os.path.isdir(spill) else None
            )
        self.files += 1
        return np.memmap(os.path.join(self._folder.name, str(self.files)), dtype, "w+", shape=(n,))


class TupleQueue:
    """Tuples (key, rank, position) by key, equal keys in the order in which they came."""

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.runs: list[list[np.ndarray]] = []  # key, rank, position; each sorted by key
        self.heads: list[int] = []

    def push(self, key: np.ndarray, rank: np.ndarray, position: np.ndarray) -> None:
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        self.runs.append([key[order], rank[order], position[order]])
        self.heads.append(0)
        while len(self.runs) > 1 and self._left(-2) <= 2 * self._left(-1):
            self._merge()

    def _left(self, run: int) -> int:
        return len(self.runs[run][0]) - self.heads[run]

    def _merge(self) -> None:
        """The last two runs become one; the older one's tuples come first among equals."""
        (old, new), (i, j) = self.runs[-2:], self.heads[-2:]
        del self.runs[-2:], self.heads[-2:]
        total = len(old[0]) - i + len(new[0]) - j
        if total * old[0].itemsize <= self.scratch.memory:
            key = np.concatenate([old[0][i:], new[0][j:]])
            order = np.argsort(key, kind="stable")
            self.runs.append([key[order]] + [np.concatenate([x[i:], y[j:]])[order] for x, y in zip(old[1:], new[1:])])
            self.heads.append(0)
            return
        out = [self.scratch.empty(total, x.dtype) for x in old]
        at = 0
        while at < total:
            a, b = old[0][i : i + SLICE], new[0][j : j + SLICE]
            if len(a) and (not len(b) or a[-1] <= b[-1] or j + len(b) == len(new[0])) and i + len(a) < len(old[0]):
                na, nb = len(a), int(np.searchsorted(b, a[-1], "left"))  # more of that key may follow in the old run
            elif j + len(b) < len(new[0]):
                na, nb = int(np.searchsorted(a, b[-1], "right")), len(b)
            else:
                na, nb = len(a), len(b)
            order = np.argsort(np.concatenate([a[:na], b[:nb]]), kind="stable")
            for k, x in enumerate(out):
                x[at : at + na + nb] = np.concatenate([old[k][i : i + na], new[k][j : j + nb]])[order]
            at, i, j = at + na + nb, i + na, j + nb
        self.runs.append(out)
        self.heads.append(0)

    def tidy(self) -> None:
        """Forget runs that are used up."""
        keep = [r for r in range(len(self.runs)) if self._left(r)]
        self.runs, self.heads = [self.runs[r] for r in keep], [self.heads[r] for r in keep]

    def least(self) -> int | None:
        return min((int(r[0][h]) for r, h in zip(self.runs, self.heads)), default=None)

    def reach(self, most: int) -> int | None:
        """The largest key up to which no run holds more than ``most`` tuples; None: any."""
        found = [int(r[0][h + most]) - 1 for r, h in zip(self.runs, self.heads) if len(r[0]) - h > most]
        return min(found, default=None)

    def counts(self, key: int) -> list[int]:
        """How many tuples of each run have at most this key."""
        return [int(np.searchsorted(r[0], key, "right")) - h for r, h in zip(self.runs, self.heads)]

    def first(self, counts: list[int]) -> list[np.ndarray]:
        """So many tuples of each run, in order of key."""
        parts = [[c[h : h + n] for c in r] for r, h, n in zip(self.runs, self.heads, counts) if n]
        if not parts:
            return [np.empty(0, np.int64)] * 3
        if len(parts) == 1:
            return [np.asarray(c) for c in parts[0]]
        key = np.concatenate([p[0] for p in parts])
        order = np.argsort(key, kind="stable")
        return [key[order]] + [np.concatenate([p[k] for p in parts])[order] for k in (1, 2)]

    def drop(self, counts: list[int]) -> None:
        self.heads = [h + n for h, n in zip(self.heads, counts)]
        self.tidy()

    def drain(self, most: int) -> Iterator[list[np.ndarray]]:
        """Everything, in batches."""
        while self.runs:
            least, reach = self.least(), self.reach(most)
            counts = self.counts(max(least, reach) if reach is not None else max(int(r[0][-1]) for r in self.runs))
            yield self.first(counts)
            self.drop(counts)


def ordered(key: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Stable order of the keys, by the queue where they exceed the memory."""
    if len(key) * 8 <= scratch.memory:
        return np.argsort(key, kind="stable")
    queue = TupleQueue(scratch)
    for lo in range(0, len(key), SLICE):
        part = np.asarray(key[lo : lo + SLICE])
        at = np.arange(lo, lo + len(part))
        queue.push(part, at, at)
    out, done = scratch.empty(len(key), np.int64), 0
    for _, _, at in queue.drain(SLICE):
        out[done : done + len(at)] = at
        done += len(at)
    return out


class RangeMin:
    """Least value of any range of a growing sequence."""

    def __init__(self, n: int, scratch: Scratch):
        size = -(-n // BLOCK) * BLOCK
        self.value = scratch.empty(size, np.int32)
        self.upto, self.since = scratch.empty(size, np.int32), scratch.empty(size, np.int32)
        self.value[:] = np.iinfo(np.int32).max
        blocks = size // BLOCK
        self.least = [np.full(blocks, np.iinfo(np.int32).max, np.int32)]
        while 2 ** len(self.least) <= blocks:
            self.least.append(self.least[0].copy())

    def append(self, start: int, values: np.ndarray) -> None:
        stop = start + len(values)
        self.value[start:stop] = values
        lo, hi = start // BLOCK, -(-stop // BLOCK)
        rows = self.value[lo * BLOCK : hi * BLOCK].reshape(-1, BLOCK)
        self.upto[lo * BLOCK : hi * BLOCK] = np.minimum.accumulate(rows, axis=1).ravel()
        self.since[lo * BLOCK : hi * BLOCK] = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.least[0][lo:hi] = rows.min(axis=1)
        for k in range(1, len(self.least)):  # least[k][b]: of the 2**k blocks that end with b
            below, half = self.least[k - 1], 2 ** (k - 1)
            own = below[lo:hi].copy()
            from_ = max(lo, half)
            if from_ < hi:
                own[from_ - lo :] = np.minimum(own[from_ - lo :], below[from_ - half : hi - half])
            self.least[k][lo:hi] = own

    def query(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least value of [lo, hi], both included."""
        a, b = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.since[lo], self.upto[hi])
        near = np.flatnonzero(a == b)
        if len(near):
            at = lo[near, None] + np.arange(BLOCK)
            last = hi[near, None]
            out[near] = self.value[np.minimum(at, last)].min(axis=1)
        far = np.flatnonzero(b - a > 1)
        if len(far):
            first, count = a[far] + 1, b[far] - a[far] - 1
            level = np.frexp(count.astype(np.float64))[1] - 1
            for k in np.unique(level):
                some = level == k
                table, last = self.least[k], b[far][some] - 1
                mid = np.minimum(table[last], table[first[some] + 2**k - 1])
                out[far[some]] = np.minimum(out[far[some]], mid)
        return out


def _kinds(text: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Of every position: whether its suffix is S, and the length of its leading run."""
    n = len(text)
    small, run = scratch.empty(n, np.bool_), scratch.empty(n, np.int32)
    small[n - 1], run[n - 1] = True, 1
    for lo in range((n - 2) // SLICE * SLICE if n > 1 else -1, -1, -SLICE):
        hi = min(n - 1, lo + SLICE)
        here, after = np.asarray(text[lo:hi]), np.asarray(text[lo + 1 : hi + 1])
        ends = np.flatnonzero(here != after)
        rise = (after > here)[ends]
        if not len(ends) or ends[-1] != hi - lo - 1:  # the last run goes on to the right
            ends = np.append(ends, hi - lo - 1 + run[hi])
            rise = np.append(rise, small[hi])
        at = np.searchsorted(ends, np.arange(hi - lo))
        small[lo:hi] = rise[at]
        run[lo:hi] = ends[at] - np.arange(hi - lo) + 1
    return small, run


def _names(text: np.ndarray, seeds: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, int]:
    """Dense rank of every piece from one seed to the next, and how many differ.

    A piece that is the beginning of another comes after it: it ends where the other one, with
    the same symbol, still falls.
    """
    m = len(seeds)
    width = max(1, int(text.max() + 1).bit_length())
    pad = (1 << width) - 1
    if pad <= int(text.max()):
        width += 1
        pad = (1 << width) - 1
    per = max(1, 62 // width)
    size = np.append(np.diff(seeds) + 1, 1)
    rank = scratch.empty(m, np.int64)
    rank[:] = 0
    active, step = np.arange(m), 0
    while len(active):
        key = scratch.empty(len(active), np.int64)
        for lo in range(0, len(active), SLICE):
            part = active[lo : lo + SLICE]
            packed = np.zeros(len(part), np.int64)
            for t in range(step * per, (step + 1) * per):
                inside = t < size[part]
                symbol = text[np.where(inside, seeds[part] + t, 0)].astype(np.int64)
                packed = (packed << width) | np.where(inside, symbol, pad)
            key[lo : lo + SLICE] = packed
        by_key = ordered(key, scratch)
        by_rank = ordered(rank[active[by_key]], scratch)
        order = by_key[by_rank]
        active, key = active[order], key[order]
        old = rank[active]
        group = np.append(True, old[1:] != old[:-1])
        new = group | np.append(True, key[1:] != key[:-1])
        at = np.arange(len(active))
        own = np.maximum.accumulate(np.where(new, at, 0))
        rank[active] = old + own - np.maximum.accumulate(np.where(group, at, 0))
        alone = new & np.append(new[1:], True)
        active = np.sort(active[~alone & ((key & pad) != pad)])
        step += 1
    used = np.zeros(m, np.int64)
    used[rank] = 1
    used = np.cumsum(used)
    return used[rank] - 1, int(used[-1])


def _agree(text: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at x and y share, looked up where they differ soon."""
    out = np.zeros(len(x), np.int64)
    active, step, last = np.arange(len(x)), np.arange(8), len(text) - 1
    while len(active):
        at = out[active, None] + step
        same = text[np.minimum(x[active, None] + at, last)] == text[np.minimum(y[active, None] + at, last)]
        whole = same.all(axis=1)
        out[active] += np.where(whole, 8, np.argmin(same, axis=1))
        active = active[whole]
    return out


def _internal(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``suffixes``, in memory: ranks by 1, 2, 4, ... symbols, refined where still equal.

    The ranks of all steps together tell how many symbols two neighbours share.
    """
    n = len(text)
    steps: list[np.ndarray] = []
    rank, active, size = np.zeros(n, np.int64), np.arange(n), 0
    while len(active):
        second = np.asarray(text).astype(np.int64) if not size else rank[active + size]
        key = rank[active] * n + second if size else second
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old = rank[active]
        at = np.arange(len(active))
        group = np.append(True, old[1:] != old[:-1])
        new = np.append(True, key[1:] != key[:-1])
        own = np.maximum.accumulate(np.where(new, at, 0))
        rank[active] = old + own - np.maximum.accumulate(np.where(group, at, 0))
        active = active[~(new & np.append(new[1:], True))]
        steps.append(rank.astype(np.int32))
        size = max(1, 2 * size)
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    a, b = place[1:-1], place[2:]
    shared = np.zeros(len(b), np.int64)
    for k in range(len(steps) - 1, -1, -1):
        shared += (steps[k][a + shared] == steps[k][b + shared]) * np.int64(1 << k)
    return place[:0:-1], np.append(0, shared[::-1]) if n > 1 else shared


class _Level:
    """Induction over one string, in ascending or (``down``) descending order."""

    def __init__(self, text, small, run, scratch: Scratch, down: bool):
        self.text, self.small, self.run, self.down = text, small, run, down
        self.top = int(text.max()) if down else 0
        self.queue = TupleQueue(scratch)
        n = len(text)
        self.place = scratch.empty(n, np.int32 if n < 1 << 31 else np.int64)
        self.seeded = scratch.empty(n, np.bool_)
        self.common = RangeMin(n, scratch)
        self.done = 0
        self.last: tuple[int, bool, int, int] | None = None  # key, seed, rank of the pusher, position

    def keys(self, at: np.ndarray) -> np.ndarray:
        symbol = self.text[at].astype(np.int64)
        return self.top - symbol if self.down else symbol

    def pushed(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these suffixes push their left neighbour, and its key (else -1)."""
        left = np.maximum(at - 1, 0)
        push = (at > 0) & (self.small[left] == self.down)
        if self.down:  # the last symbol's suffix is in neither order
            push &= at < len(self.text)
        return push, np.where(push, self.keys(left), -1)

    def leave(self, key, seed, rank, at, shared, push, left) -> None:
        """These suffixes come next in the order."""
        m = len(at)
        if not m:
            return
        k0, s0, r0, p0 = self.last or (-1, False, 0, 0)
        key_, seed_, rank_, at_ = (np.append(v, x[:-1]) for v, x in ((k0, key), (s0, seed), (r0, rank), (p0, at)))
        lcp = np.zeros(m, np.int64)
        same = key_ == key
        both = same & ~seed_ & ~seed
        if both.any():
            lcp[both] = 1 + self.common.query(rank_[both] + 1, rank[both])
        seam = same & ~seed_ & seed
        lcp[seam] = np.minimum(self.run[at_[seam]], self.run[at[seam]])
        given = same & seed_ & seed
        lcp[given] = shared[given]
        self.place[self.done : self.done + m] = at
        self.seeded[self.done : self.done + m] = seed
        self.common.append(self.done, lcp)
        some = np.flatnonzero(push)
        self.queue.push(left[some], self.done + some, at[some] - 1)
        self.done += m
        self.last = int(key[-1]), bool(seed[-1]), int(rank[-1]), int(at[-1])

    def induce(self, seeds: np.ndarray, shared: np.ndarray) -> None:
        """All suffixes of the wanted kind, among the given sorted ones of the other kind."""
        queue, next_, n_seeds, size = self.queue, 0, len(seeds), BATCH
        seed_keys = self.keys(np.asarray(seeds))
        while queue.runs or next_ < n_seeds:
            least, reach = queue.least(), queue.reach(size)
            if next_ < n_seeds:
                first = int(seed_keys[next_])
                least = first if least is None else min(least, first)
                if next_ + size < n_seeds:
                    limit = int(seed_keys[next_ + size]) - 1
                    reach = limit if reach is None else min(reach, limit)
            if reach is not None and reach <= least:  # one key with many tuples: piece by piece
                counts = queue.counts(least)
                if sum(counts):
                    room = BATCH
                    for r, c in enumerate(counts):
                        counts[r] = min(c, room)
                        room -= counts[r]
                    key, rank, at = queue.first(counts)
                    queue.drop(counts)
                    self.leave(key, np.zeros(len(at), bool), rank, at, rank, *self.pushed(at))
                else:
                    stop = min(next_ + BATCH, int(np.searchsorted(seed_keys, least, "right")))
                    at, key = np.asarray(seeds[next_:stop]), seed_keys[next_:stop]
                    self.leave(key, np.ones(len(at), bool), at, at, np.asarray(shared[next_:stop]), *self.pushed(at))
                    next_ = stop
                continue
            if reach is None:
                reach = max([int(r[0][-1]) for r in queue.runs] + ([int(seed_keys[-1])] if next_ < n_seeds else []))
            counts = queue.counts(reach)
            key, rank, at = queue.first(counts)
            stop = max(next_, int(np.searchsorted(seed_keys, reach, "right")))
            s_at, s_key = np.asarray(seeds[next_:stop]), seed_keys[next_:stop]
            all_key = np.concatenate([key, s_key])
            seed = np.arange(len(all_key)) >= len(key)
            order = np.argsort(2 * all_key + seed, kind="stable")
            all_key, seed = all_key[order], seed[order]
            all_at = np.concatenate([at, s_at]).astype(np.int64)[order]
            all_rank = np.concatenate([rank, np.zeros(len(s_at), np.int64)])[order]
            shares = np.concatenate([np.zeros(len(at), np.int64), np.asarray(shared[next_:stop])])[order]
            push, left = self.pushed(all_at)
            inside = left[push & (left <= reach)]
            if len(inside):  # what comes in between must wait for those that push it
                limit = int(inside.min())
                keep = all_key < limit if limit > least else (all_key == least) & ~seed
                if limit == least:
                    counts, stop = queue.counts(least), next_
                else:
                    counts = queue.counts(limit - 1)
                    stop = max(next_, int(np.searchsorted(seed_keys, limit - 1, "right")))
                all_key, seed, all_at, all_rank, shares, push, left = (
                    x[keep] for x in (all_key, seed, all_at, all_rank, shares, push, left)
                )
                size = max(64, 2 * len(all_key))
            else:
                size = min(BATCH, 2 * size)
            queue.drop(counts)
            next_ = stop
            self.leave(all_key, seed, all_rank, all_at, shares, push, left)


def suffixes(text: np.ndarray, scratch: Scratch, inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` without its last symbol, descending, and what each shares with the one before.

    ``text`` holds integers from 0 on and ends in a 0 that occurs nowhere else.
    """
    n = len(text)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if inner and n * INTERNAL_BYTES <= scratch.memory:
        return _internal(text)
    small, run = _kinds(text, scratch)
    parts = []
    for lo in range(0, n - 1, SLICE):
        hi = min(n - 1, lo + SLICE)
        parts.append(np.flatnonzero(small[lo + 1 : hi + 1] & ~small[lo:hi]) + lo + 1)
    seeds = np.concatenate(parts)
    names, kinds = _names(text, seeds, scratch)
    if kinds == len(seeds):
        order = scratch.empty(kinds, np.int64)
        order[names] = np.arange(kinds)
        equal = np.zeros(kinds, np.int64)
    else:
        down, between = suffixes(names, scratch, inner=True)
        order = np.append(len(seeds) - 1, down[::-1])  # the last seed is the least suffix
        equal = np.concatenate([[0, 0], between[1:][::-1]])
    del names
    before, after, same = order[:-1], order[1:], equal[1:]
    shared = scratch.empty(len(order), np.int64)
    shared[0] = 0
    for lo in range(0, len(after), SLICE):
        a, b, h = (x[lo : lo + SLICE] for x in (before, after, same))
        x, y = seeds[a + h], seeds[b + h]
        shared[lo + 1 : lo + 1 + len(a)] = x - seeds[a] + _agree(text, x, y)
    up = _Level(text, small, run, scratch, down=False)
    up.induce(seeds[order], shared)
    # the L suffixes, in descending order, with what each shares with the one before
    of_l = np.flatnonzero(~up.seeded[: up.done])[::-1]
    place = np.asarray(up.place[of_l]).astype(np.int64)
    ahead = np.asarray(up.common.value[of_l]).astype(np.int64)  # shared with the next lower one
    again = np.zeros(len(place), np.int64)
    again[1:] = np.where(of_l[:-1] - of_l[1:] == 1, ahead[:-1], 0)
    del up
    level = _Level(text, small, run, scratch, down=True)
    level.induce(place, again)
    return level.place[: level.done], level.common.value[: level.done]
