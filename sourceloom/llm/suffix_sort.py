"""Suffix order of a shard by external induced sorting, with the common prefixes of neighbours.

The text is an array of numbers that ends with 0; a 0 elsewhere ends a segment, and 0s count as different, the earlier the less.
Each step is a few array operations on a batch, and whatever grows with the shard lies in ``Scratch``: arrays become files
beyond a share of the memory, queues write their oldest tuples to files, sorts go range by range.

1. A place is small (S) if its suffix is less than the next one, else large (L); S places after an L place are sampled.
2. The stretches between sampled places are sorted and named. Equal names are told apart by the order of the string of names,
   which has at most half the length: by the same steps again (recursion), or by doubling once it fits in memory.
3. L suffixes are induced: a queue holds tuples (first letter, place, common prefix) in suffix order. The least letter is taken
   out; each tuple whose preceding letter is not less enters the queue of that letter. As what is taken out is in order, so is what
   enters, so each letter's queue is first in, first out, and letters are kept in ranges that are split when they are due.
4. S suffixes are induced likewise from the largest letter down, where all suffixes come out.
5. Common prefixes travel with the tuples: two suffixes with the same letter before the suffixes they were induced from have one
   letter more in common than those, and these have the least of the common prefixes taken out between them. Sampled suffixes
   are compared letter by letter, up to ``limit``; so are the last L and the first S suffix of a letter.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

FAR = np.int32(2**30)


class Scratch:
    """Arrays and tuple queues of one shard; what exceeds its share of ``memory`` bytes lies in files below ``folder``."""

    def __init__(self, folder: str, memory: int):
        self.memory, self.folder, self.files, self.held = memory, folder, 0, 0
        self.path: str | None = None

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        if self.path:
            shutil.rmtree(self.path, ignore_errors=True)

    def file(self) -> str:
        if self.path is None:
            self.path = tempfile.mkdtemp(prefix="suffixes-", dir=self.folder)
        self.files += 1
        return os.path.join(self.path, str(self.files))

    def array(self, n: int, kind) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.memory // 16 or not n:
            return np.empty(n, kind)
        return np.memmap(self.file(), kind, "w+", shape=(n,))

    @property
    def block(self) -> int:
        """Entries that a step handles at once."""
        return max(1024, self.memory // 256)

    def argsort(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Order by (high, low); beyond a block, key range by key range."""
        n = len(high)
        if n <= self.block:
            return np.lexsort((low, high))
        step = max(1, n // 4096)
        sample = np.unique(np.rec.fromarrays([high[::step], low[::step]], names="h,l"))
        cuts = sample[:: max(1, len(sample) * self.block // (2 * n))][1:]
        order, at, before = self.array(n, np.int64), 0, None
        for cut in [*cuts.tolist(), None]:
            for start in range(0, n, self.block):
                h, l = high[start : start + self.block], low[start : start + self.block]
                sound = np.ones(len(h), bool)
                if before is not None:
                    sound &= (h > before[0]) | ((h == before[0]) & (l >= before[1]))
                if cut is not None:
                    sound &= (h < cut[0]) | ((h == cut[0]) & (l < cut[1]))
                found = np.flatnonzero(sound) + start
                order[at : at + len(found)] = found
                at += len(found)
                if start == 0:
                    first = at - len(found)
            part = np.array(order[first:at])
            order[first:at] = part[np.lexsort((low[part], high[part]))]
            before = cut
        return order


class Spool:
    """Tuples (letter, place, common prefix) in the order they came, the oldest in a file."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.chunks, self.path, self.size = scratch, [], None, 0

    def append(self, rows: np.ndarray) -> None:
        self.chunks.append(rows)
        self.size += rows.nbytes
        self.scratch.held += rows.nbytes

    def spill(self) -> None:
        if self.path is None:
            self.path = self.scratch.file()
        with open(self.path, "ab") as out:
            for rows in self.chunks:
                out.write(np.ascontiguousarray(rows).tobytes())
        self.drop()

    def drop(self) -> None:
        self.scratch.held -= self.size
        self.chunks, self.size = [], 0

    def take(self) -> np.ndarray:
        """All tuples; the spool is empty afterwards."""
        parts = []
        if self.path:
            parts.append(np.fromfile(self.path, np.int32).reshape(-1, 3))
            os.unlink(self.path)
            self.path = None
        parts += self.chunks
        self.drop()
        return np.concatenate(parts) if parts else np.empty((0, 3), np.int32)


class LetterQueue:
    """A queue of suffix tuples by first letter, for letters that come in ascending or descending order.

    Tuples of a letter leave in the order they came. Letters are spooled by range; a range is split by letter when its first
    letter is due, and from then on its letters have lists of their own.
    """

    RANGES = 512

    def __init__(self, letters: int, scratch: Scratch):
        self.width = -(-letters // self.RANGES)
        self.scratch, self.spools = scratch, {}
        self.range, self.due = -1, {}

    def push(self, rows: np.ndarray, cuts: np.ndarray) -> None:
        """``rows``: sorted by letter; ``cuts``: where a letter begins."""
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], strict=True):
            letter = int(rows[a, 0])
            if letter // self.width == self.range:
                self.due.setdefault(letter, []).append(rows[a:b])
            else:
                self.spools.setdefault(letter // self.width, Spool(self.scratch)).append(rows[a:b])
        if self.scratch.held > self.scratch.memory // 4:
            for spool in self.spools.values():
                spool.spill()

    def pop(self, letter: int) -> np.ndarray | None:
        """All tuples of the letter that have come so far, None if there are none."""
        if letter // self.width != self.range:
            self.range, self.due = letter // self.width, {}
            spool = self.spools.pop(self.range, None)
            rows = spool.take() if spool else np.empty((0, 3), np.int32)
            if len(rows):
                rows = rows[np.argsort(rows[:, 0], kind="stable")]
                cuts = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
                for part in np.split(rows, cuts[1:]):
                    self.due[int(part[0, 0])] = [part]
        found = self.due.pop(letter, None)
        return np.concatenate(found) if found else None


def sampled_places(t: np.ndarray, scratch: Scratch) -> np.ndarray:
    """S places after an L place, in ascending order."""
    found: list[np.ndarray] = []
    n, small_next = len(t), True  # the last 0 is small
    for end in range(n, 0, -scratch.block):
        start = max(0, end - scratch.block)
        part = np.asarray(t[start : min(n, end + 1)]).astype(np.int64)
        step = np.sign(np.diff(part)) if end < n else np.append(np.sign(np.diff(part)), 1)
        settled = np.where(step != 0, np.arange(len(step)), len(step))
        settled = np.minimum.accumulate(settled[::-1])[::-1]
        small = np.append(step > 0, small_next)[settled]
        if end < n and small_next and not small[-1]:
            found.append(np.array([end]))
        found.append(np.flatnonzero(small[1:] & ~small[:-1])[::-1] + start + 1)
        small_next = bool(small[0])
    return np.concatenate(found)[::-1]


def refined(rank: np.ndarray, active: np.ndarray, key: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Split groups of equal rank by key. A rank is the number of entries that are less.

    Gives the active entries in their new order and whether each shares its new rank with another.
    """
    order = scratch.argsort(rank[active], key)
    active, key = active[order], key[order]
    old = rank[active]
    head = np.append(True, old[1:] != old[:-1])
    fresh = head | np.append(True, key[1:] != key[:-1])
    places = np.arange(len(active))
    group = np.maximum.accumulate(np.where(head, places, 0))
    part = np.maximum.accumulate(np.where(fresh, places, 0))
    rank[active] = old + (part - group)
    shared = ~(fresh & np.append(fresh[1:], True))
    return active, shared


def named(t: np.ndarray, places: np.ndarray, scratch: Scratch) -> np.ndarray:
    """For each sampled place, how many of their stretches are less; the 0s are told apart by place."""
    m = len(places)
    length = np.append(np.diff(places) + 1, 1)
    rank = scratch.array(m, np.int64)
    ends = np.asarray(t[places]) == 0
    rank[:] = np.where(ends, np.cumsum(ends) - 1, ends.sum())
    active = np.flatnonzero(~ends)
    top = int(t.max()) + 1  # an ended stretch counts as larger: its last place is S where a longer one has an L
    bits = top.bit_length()
    per, offset = max(1, 63 // bits), 0
    while len(active):
        key = np.zeros(len(active), np.int64)
        start, size = places[active] + offset, length[active] - offset
        for k in range(per):
            letter = np.where(size > k, t[np.minimum(start + k, len(t) - 1)].astype(np.int64), top)
            key = (key << bits) | letter
        active, shared = refined(rank, active, key, scratch)
        offset += per
        # one that ends right here is still to be told from those that go on
        active = active[shared & (length[active] >= offset)]
    return rank


def doubled(rank: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Rank of every suffix of a string, from the ranks of its letters, by comparing twice as many letters at each step."""
    rank = np.array(rank)
    n, h = len(rank), 1
    size = np.bincount(rank, minlength=n)
    active = np.flatnonzero(size[rank] > 1)
    while len(active):
        after = active + h
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        active, shared = refined(rank, active, key, scratch)
        active = active[shared]
        h *= 2
    return rank


def sampled_order(t: np.ndarray, places: np.ndarray, scratch: Scratch, base: int) -> np.ndarray:
    """The sampled places in suffix order."""
    rank = named(t, places, scratch)
    m = len(places)
    if m > base:
        order = scratch.argsort(rank, np.zeros(m, np.int8))
        by_rank = rank[order]
        names = scratch.array(m + 1, np.int32)
        names[order] = np.cumsum(np.append(True, by_rank[1:] != by_rank[:-1]))
        names[m] = 0
        if int(names[:m].max()) < m:
            found, at = scratch.array(m, np.int64), m
            for part, _ in suffix_order(names, None, scratch, base):
                found[at - len(part) : at] = part[::-1]
                at -= len(part)
            return places[found]
    else:
        rank = doubled(rank, scratch)
    out = scratch.array(m, np.int64)
    out[rank] = places
    return out


class Prefixes:
    """Letters that two places have in common, at most ``limit``; a 0 equals nothing. Four letters are compared at once."""

    def __init__(self, t: np.ndarray, limit: int, scratch: Scratch):
        self.limit = limit
        padded = scratch.array(len(t) + 4, np.uint16)
        padded[: len(t)], padded[len(t) :] = t, 0
        self.words = np.ndarray(len(t) + 1, np.uint64, padded, strides=(2,))
        self.ends = np.concatenate([np.flatnonzero(t[a:b] == 0) + a for a, b in blocks(len(t), scratch.block)])

    def room(self, places: np.ndarray) -> np.ndarray:
        """Letters before the next 0."""
        return self.ends[np.searchsorted(self.ends, places)] - places

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.astype(np.int64), b.astype(np.int64)
        most = np.minimum(np.minimum(self.room(a), self.room(b)), self.limit)
        out = np.zeros(len(a), np.int64)
        active = np.flatnonzero(most > 0)
        while len(active):
            differ = self.words[a[active] + out[active]] ^ self.words[b[active] + out[active]]
            equal = np.full(len(active), 4)
            some = np.flatnonzero(differ)
            lowest = differ[some] & (~differ[some] + np.uint64(1))
            equal[some] = np.log2(lowest.astype(np.float64)).astype(np.int64) // 16
            out[active] += equal
            active = active[(equal == 4) & (out[active] < most[active])]
        return np.minimum(out, most).astype(np.int32)


class Induction:
    """One direction of induced sorting: takes suffixes in order and queues those one place before."""

    def __init__(self, t: np.ndarray, letters: int, limit: int | None, scratch: Scratch):
        self.t, self.limit = t, limit
        self.queue = LetterQueue(letters, scratch)
        self.least = np.zeros(letters, np.int32) if limit is not None else None

    def take(self, place: np.ndarray, prefix: np.ndarray, letter: int, keep) -> None:
        """``keep(before, letter)``: which preceding letters enter the queue."""
        if not len(place):
            return
        before = self.t[np.maximum(place - 1, 0)].astype(np.int32)
        at = np.flatnonzero(keep(before, letter) & (place > 0) & (before > 0))
        at = at[np.argsort(before[at], kind="stable")]
        found = before[at]
        fresh = np.append(True, found[1:] != found[:-1]) if len(at) else np.empty(0, bool)
        cuts = np.flatnonzero(fresh)
        rows = np.empty((len(at), 3), np.int32)
        rows[:, 0], rows[:, 1] = found, place[at] - 1
        if self.limit is None:
            rows[:, 2] = 0
        else:
            padded = np.append(prefix, FAR)
            spans = np.empty(2 * len(at), np.int64)
            spans[0::2] = np.where(fresh, 0, np.append(0, at[:-1] + 1))
            spans[1::2] = at + 1
            least = np.minimum.reduceat(padded, spans)[::2] if len(at) else np.empty(0, np.int32)
            least[cuts] = np.minimum(least[cuts], self.least[found[cuts]])
            rows[:, 2] = np.minimum(least + 1, self.limit)
            np.minimum(self.least, prefix.min(), out=self.least)
            if len(at):
                last = np.append(cuts[1:], len(at)) - 1
                behind = np.minimum.accumulate(padded[::-1])[::-1]
                self.least[found[last]] = behind[at[last] + 1]
        if len(at):
            self.queue.push(rows, cuts)


def blocks(n: int, size: int) -> Iterator[tuple[int, int]]:
    for start in range(0, n, size):
        yield start, min(n, start + size)


def suffix_order(t: np.ndarray, limit: int | None, scratch: Scratch, base: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefixes) of all suffixes but those of 0s, largest first, in batches.

    A common prefix is that with the suffix before, at most ``limit``, for letters below 2**16; with ``limit`` None none are made.
    """
    n, letters = len(t), int(t.max()) + 1
    places = sampled_places(t, scratch)
    seeds = sampled_order(t, places, scratch, base)
    m = len(seeds)
    prefixes = scratch.array(m, np.int32)
    shared = Prefixes(t, limit, scratch) if limit is not None else None
    for a, b in blocks(m, scratch.block // 8):
        part = seeds[a:b]
        if limit is None:
            prefixes[a:b] = 0
        else:
            prefixes[a:b] = shared.common(part, seeds[np.maximum(np.arange(a, b) - 1, 0)])
    prefixes[:1] = 0
    first = np.asarray(t[seeds]) if m <= scratch.block else None
    bounds = np.arange(letters + 1)
    if first is None:
        first = scratch.array(m, t.dtype)
        for a, b in blocks(m, scratch.block):
            first[a:b] = t[seeds[a:b]]
    start_of = np.searchsorted(first, bounds)

    large_place, large_prefix, large = scratch.array(n, np.int32), scratch.array(n, np.int32), 0
    large_start = scratch.array(letters + 1, np.int64)
    up = Induction(t, letters, limit, scratch)
    for letter in range(letters):
        large_start[letter] = large
        while letter and (rows := up.queue.pop(letter)) is not None:
            if large == large_start[letter]:
                rows[0, 2] = 0
            for a, b in blocks(len(rows), scratch.block):
                up.take(rows[a:b, 1], rows[a:b, 2], letter, np.greater_equal)
            large_place[large : large + len(rows)] = rows[:, 1]
            large_prefix[large : large + len(rows)] = rows[:, 2]
            large += len(rows)
        a, b = int(start_of[letter]), int(start_of[letter + 1])
        if a < b:
            if limit is not None:
                mixed = large > large_start[letter]
                prefixes[a] = shared.common(large_place[large - 1 : large], seeds[a : a + 1])[0] if mixed else 0
            for c, d in blocks(b - a, scratch.block):
                up.take(np.asarray(seeds[a + c : a + d]), np.asarray(prefixes[a + c : a + d]), letter, np.greater)
    large_start[letters] = large

    down = Induction(t, letters, limit, scratch)
    for letter in range(letters - 1, 0, -1):
        last = None
        while (rows := down.queue.pop(letter)) is not None:
            if last is None:
                rows[0, 2] = 0
            for a, b in blocks(len(rows), scratch.block):
                down.take(rows[a:b, 1], rows[a:b, 2], letter, np.less_equal)
            last = rows[-1:, 1]
            yield rows[:, 1], rows[:, 2]
        a, b = int(large_start[letter]), int(large_start[letter + 1])
        for end in range(b, a, -scratch.block):
            start = max(a, end - scratch.block)
            place = np.array(large_place[start:end][::-1])
            prefix = np.zeros(len(place), np.int32)
            if limit is not None:  # what is kept with a suffix is common with the smaller one
                prefix[1:] = large_prefix[start + 1 : end][::-1]
                if end < b:
                    prefix[0] = large_prefix[end]
                elif last is not None:
                    prefix[0] = shared.common(place[:1], last)[0]
            down.take(place, prefix, letter, np.less)
            yield place, prefix
