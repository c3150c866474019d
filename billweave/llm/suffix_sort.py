"""Suffix array with common prefixes by induced sorting, within a fixed amount of memory.

Suffixes that begin a rising run behind a falling one (seeds) are named and sorted, by recursion where names repeat. Scanning the
sorted seeds by first symbol induces all falling suffixes, scanning those downwards induces all rising ones: the
predecessor of each scanned suffix, if its symbol is further on, goes to a priority queue with its symbol as key and
arrival as order. Keys are never pushed behind the scan, so the queue is a row of first-in-first-out queues, one for each range
of symbols, whose blocks go to disk when memory is short. Each tuple carries its common prefix with the tuple before it in its
symbol: one more than the least prefix between the two suffixes that induced them. Whole ranges are taken from the queue at a
time, so all steps work on arrays; texts and orders beyond the memory limit are mapped scratch files.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

SMALL = 2048
BATCH = 1 << 18


class Scratch:
    """Memory limit and scratch files of one task, in the folder in which Spark's own spills of this executor go."""

    def __init__(self, memory: int):
        self.memory, self.held, self.spilled = memory, 0, 0
        self.folder, self.files = None, 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)

    def file(self) -> str:
        if self.folder is None:
            places = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
            self.folder = tempfile.mkdtemp(prefix="suffixes-", dir=places[0] or None)
        self.files += 1
        return f"{self.folder}/{self.files}"

    def array(self, n: int, kind: type, fill: int | None = None) -> np.ndarray:
        """An array in memory, or mapped from a file if it is an eighth of the limit or more."""
        size = max(n, 1) * np.dtype(kind).itemsize
        if size * 8 < self.memory:
            made = np.empty(max(n, 1), kind)
        else:
            self.spilled += size
            made = np.memmap(self.file(), kind, "w+", shape=max(n, 1))
        if fill is not None:
            made[:] = fill
        return made[:n]


TUPLE = np.dtype([("symbol", np.int64), ("place", np.int64), ("prefix", np.int16)])


class Queue:
    """First in, first out; blocks are kept in memory until the owner spills them to a file."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.blocks, self.path = scratch, [], None

    def push(self, rows: np.ndarray) -> None:
        if len(rows):
            self.blocks.append(rows)
            self.scratch.held += rows.nbytes

    def spill(self) -> None:
        if self.blocks:
            self.path = self.path or self.scratch.file()
            with open(self.path, "ab") as file:
                for rows in self.blocks:
                    rows.tofile(file)
                    self.scratch.held -= rows.nbytes
                    self.scratch.spilled += rows.nbytes
            self.blocks = []

    def read(self, size: int) -> Iterator[np.ndarray]:
        """All rows, in blocks; the queue is empty then."""
        blocks, self.blocks = self.blocks, []
        if self.path:
            with open(self.path, "rb") as file:
                while len(rows := np.fromfile(file, TUPLE, size)):
                    yield rows
            os.remove(self.path)
            self.path = None
        for rows in blocks:
            self.scratch.held -= rows.nbytes
            yield from (rows[i:i + size] for i in range(0, len(rows), size))


class PriorityQueue:
    """One queue for each range of symbols; ``push`` takes tuples sorted by symbol, in order of arrival within one."""

    def __init__(self, scratch: Scratch, bounds: np.ndarray):
        self.scratch, self.bounds = scratch, bounds
        self.queues = [Queue(scratch) for _ in range(len(bounds) - 1)]

    def push(self, rows: np.ndarray) -> None:
        cuts = np.searchsorted(rows["symbol"], self.bounds)
        for i in np.flatnonzero(np.diff(cuts)):
            self.queues[i].push(rows[cuts[i]:cuts[i + 1]])
        if self.scratch.held * 4 > self.scratch.memory:
            for queue in self.queues:
                queue.spill()

    def take(self, i: int) -> np.ndarray:
        """All tuples of one range, by symbol, and in order of arrival within one."""
        blocks = list(self.queues[i].read(BATCH))
        rows = np.concatenate(blocks) if blocks else np.empty(0, TUPLE)
        return rows[np.argsort(rows["symbol"], kind="stable")]


class Least:
    """Minima over stretches of an array."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of values[first..last], both included, first <= last."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.rows[0].dtype)
        for k in np.flatnonzero(np.bincount(level)):
            at = np.flatnonzero(level == k)
            row = self.rows[k]
            out[at] = np.minimum(row[first[at]], row[last[at] - (1 << int(k)) + 1])
        return out


def tuples(symbol: np.ndarray, place: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    rows = np.empty(len(place), TUPLE)
    rows["symbol"], rows["place"], rows["prefix"] = symbol, place, prefix
    return rows


def chosen_prefixes(prefix: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Common prefix of each chosen suffix (by index) with the one chosen before it; of the first one, with all before."""
    if not len(chosen):
        return prefix[:0]
    starts = np.concatenate([[0], chosen[:-1] + 1])
    return np.minimum.reduceat(prefix[:chosen[-1] + 1], starts)


class Scan:
    """One pass over sorted suffixes that induces others; ``down`` scans from the largest symbol."""

    def __init__(self, text: np.ndarray, counts: np.ndarray, down: bool, cap: int, scratch: Scratch, room: int):
        self.text, self.down, self.cap, self.scratch = text, down, cap, scratch
        self.last = len(counts) - 1
        counts = counts[::-1] if down else counts
        self.bounds = symbol_ranges(counts, max(SMALL, min(BATCH, len(text) // 16)), scratch)
        self.queue = PriorityQueue(scratch, self.bounds)
        self.batch_of = scratch.array(len(counts), np.int32, -1)  # batch of the last tuple that came for a symbol
        self.behind = scratch.array(len(counts), np.int16)  # least prefix scanned behind what induced it, in that batch
        self.batches: list[int] = []  # least prefix of each batch
        self.place, self.prefix = scratch.array(room, np.int64), scratch.array(room, np.int16)
        self.found = 0

    def symbols(self, places: np.ndarray) -> np.ndarray:
        found = self.text[places].astype(np.int64)
        return self.last - found if self.down else found

    def keep(self, place: np.ndarray, prefix: np.ndarray) -> None:
        self.place[self.found:self.found + len(place)] = place
        self.prefix[self.found:self.found + len(place)] = prefix
        self.found += len(place)

    def since(self, symbol: np.ndarray, up_to: np.ndarray) -> np.ndarray:
        """Least prefix since the last tuple of a symbol, whose inducer lies in an earlier batch."""
        behind = np.minimum.accumulate(np.array([self.cap, *self.batches[::-1]], np.int16))[::-1]
        batch = self.batch_of[symbol]
        return np.where(batch >= 0, 1 + np.minimum(np.minimum(self.behind[symbol], behind[batch + 1]), up_to), 0)

    def induce(self, symbol: np.ndarray, place: np.ndarray, prefix: np.ndarray, end: int) -> None:
        """Queue the predecessors, of symbol ``end`` or later, of a scanned batch."""
        if not len(place):
            return
        rank = np.flatnonzero(place > 0)
        own = self.symbols(place[rank] - 1)
        there = (own > symbol[rank]) & (own >= end)
        rank, own = rank[there], own[there]
        order = np.argsort(own, kind="stable")
        rank, own = rank[order], own[order]
        made = np.empty(len(own), np.int64)
        if len(own):
            same = np.concatenate([[False], own[1:] == own[:-1]])
            at = np.flatnonzero(same)
            made[at] = 1 + Least(prefix).between(rank[at - 1] + 1, rank[at]).astype(np.int64)
            first, last = np.flatnonzero(~same), np.append(np.flatnonzero(~same)[1:] - 1, len(own) - 1)
            made[first] = self.since(own[first], np.minimum.accumulate(prefix)[rank[first]])
            rest = np.append(np.minimum.accumulate(prefix[::-1])[::-1], np.int16(self.cap))
            self.behind[own[last]] = rest[rank[last] + 1]
            self.batch_of[own[last]] = len(self.batches)
        self.queue.push(tuples(own, place[rank] - 1, np.minimum(made, self.cap)))
        self.batches.append(int(prefix.min()))

    def run_length(self, place: np.ndarray) -> np.ndarray:
        """How often the first symbol of each suffix stands at its begin."""
        length, active = np.ones(len(place), np.int64), np.arange(len(place))
        while len(active):
            p, following = place[active], place[active] + length[active]
            inside = (length[active] < self.cap) & (following < len(self.text))
            active = active[inside & (self.text[np.where(inside, following, p)] == self.text[p])]
            length[active] += 1
        return length

    def equal_before(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Indexes of suffixes whose predecessor has the same symbol."""
        at = np.flatnonzero(place > 0)
        return at[self.symbols(place[at] - 1) == symbol[at]]

    def one_symbol(self, i: int, seeds: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        """A symbol of its own range, in blocks: induced suffixes by the length of their run, then the seeds."""
        symbol = int(self.bounds[i])
        queue, depth, deepest = self.queue.queues[i], 0, -1
        while True:
            longer, carried, fresh = Queue(self.scratch), self.cap, True
            for rows in queue.read(BATCH):
                place, prefix, deepest = rows["place"], rows["prefix"], depth
                self.keep(place, prefix)
                self.induce(np.full(len(place), symbol), place, prefix, symbol + 1)
                at = self.equal_before(place, np.full(len(place), symbol))
                if len(at):
                    made = chosen_prefixes(prefix, at).astype(np.int64)
                    made[0] = depth if fresh else min(made[0], carried)
                    longer.push(tuples(np.full(len(at), symbol), place[at] - 1, np.minimum(made + 1, self.cap)))
                    fresh, carried = False, self.cap
                    rest = prefix[at[-1] + 1:]
                else:
                    rest = prefix
                carried = min(carried, int(rest.min())) if len(rest) else carried
            if fresh:
                break
            if self.scratch.held * 4 > self.scratch.memory:
                longer.spill()
            queue, depth = longer, depth + 1
        first = True
        for place, prefix in seeds:
            if first and len(place):
                prefix = prefix.copy()
                prefix[0] = min(deepest + 1, int(self.run_length(place[:1])[0]))
                first = False
            self.induce(np.full(len(place), symbol), place, prefix, symbol + 1)

    def range_of_symbols(self, i: int, seed_place: np.ndarray, seed_prefix: np.ndarray) -> None:
        """A range of rarer symbols at once. Suffixes of the range that suffixes of the range induce are added, until
        none is left to add; then prefixes that depend on one another are worked out in the same way."""
        begin, end = int(self.bounds[i]), int(self.bounds[i + 1])
        rows = self.queue.take(i)
        seed_symbol = self.symbols(seed_place)
        n = len(rows)
        parent = np.empty(0, np.int64)
        more_symbol, more_place = parent, parent
        while True:
            symbol, place = np.concatenate([rows["symbol"], more_symbol]), np.concatenate([rows["place"], more_place])
            key = (symbol - begin) * (n + 1 + len(seed_place) * 2 + len(self.text)) + np.concatenate([np.arange(n), n + parent])
            order = np.argsort(key, kind="stable")
            symbol, place = symbol[order], place[order]
            # (symbol, run, base): a suffix whose run is longer by `run` than that of the one at index `base`
            base, run, now = [np.arange(len(place))], [np.zeros(len(place), np.int64)], np.arange(len(place))
            places, symbols, depth = [place], [symbol], 0
            while len(now):
                at = self.equal_before(places[-1], symbols[-1])
                depth += 1
                now = base[-1][at]
                if len(now):
                    base.append(now)
                    run.append(np.full(len(now), depth))
                    symbols.append(symbols[-1][at])
                    places.append(places[-1][at] - 1)
            base, run, symbols, places = map(np.concatenate, (base, run, symbols, places))
            if depth > 1:
                by = np.lexsort((base, run, symbols))
                base, run, symbols, places = base[by], run[by], symbols[by], places[by]
            scan = np.argsort(np.concatenate([2 * symbols, 2 * seed_symbol + 1]), kind="stable")
            scan_symbol = np.concatenate([symbols, seed_symbol])[scan]
            scan_place = np.concatenate([places, seed_place])[scan]
            rank = np.flatnonzero(scan_place > 0)
            own = self.symbols(scan_place[rank] - 1)
            inside = (own > scan_symbol[rank]) & (own < end)
            whole = inside.sum() == len(parent)
            parent, more_symbol = rank[inside], own[inside]
            more_place = scan_place[parent] - 1
            if whole:  # the same suffixes in the same order, with their inducers' places in this scan
                break
        prefix = self.range_prefixes(rows, seed_prefix, seed_place, order, symbol, base, run, symbols, scan, scan_symbol, parent)
        induced = scan < len(places)
        self.keep(scan_place[induced], prefix[induced])
        self.induce(scan_symbol, scan_place, prefix, end)

    def range_prefixes(self, rows, seed_prefix, seed_place, order, symbol, base, run, symbols, scan, scan_symbol, parent):
        n, cap = len(rows), self.cap
        first_of_symbol = np.concatenate([[True], symbol[1:] != symbol[:-1]]) if len(symbol) else np.empty(0, bool)
        own = np.concatenate([rows["prefix"].astype(np.int64), np.full(len(parent), cap)])[order]
        added = np.flatnonzero(order >= n)
        by_parent = parent[order[added] - n]
        before = np.maximum(added - 1, 0)
        kind = np.where(first_of_symbol[added], 0, np.where(order[before] < n, 1, 2))
        previous = np.where(kind == 2, parent[np.maximum(order[before] - n, 0)] if len(parent) else 0, 0)
        deeper = np.flatnonzero(run > 0)
        same_run = (run[deeper - 1] == run[deeper]) & (symbols[deeper - 1] == symbols[deeper])
        is_seed = scan >= len(symbols)
        starts = np.concatenate([[True], scan_symbol[1:] != scan_symbol[:-1]]) if len(scan) else np.empty(0, bool)
        meet = np.flatnonzero(is_seed & ~starts & np.concatenate([[True], ~is_seed[:-1]])) if len(scan) else np.empty(0, np.int64)
        junction = np.minimum(run[scan[meet - 1]] + 1, self.run_length(seed_place[scan[meet] - len(symbols)]))
        while True:
            full = own[base]
            if len(deeper):
                least = Least(own)
                at = deeper[same_run]
                full[at] = run[at] + least.between(base[at - 1] + 1, base[at])
                at = deeper[~same_run]
                full[at] = run[at]
            prefix = np.concatenate([full, seed_prefix.astype(np.int64)])[scan]
            prefix[starts] = 0
            prefix[meet] = junction
            prefix = np.minimum(prefix, cap)
            if not len(added):
                break
            made = np.zeros(len(added), np.int64)
            at = kind == 1
            made[at] = self.since(symbol[added[at]], np.minimum.accumulate(prefix)[by_parent[at]])
            at = kind == 2
            made[at] = 1 + Least(prefix).between(previous[at] + 1, by_parent[at])
            made = np.minimum(made, cap)
            if (own[added] == made).all():
                break
            own[added] = made
        return prefix.astype(np.int16)

    def run(self, place: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scan all seeds, given in order with the prefix each shares with the one before; the induced suffixes in order."""
        at = 0
        for i in range(len(self.bounds) - 1):
            begin, end = self.bounds[i], self.bounds[i + 1]
            if end - begin == 1:
                def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                    nonlocal at
                    while at < len(place):
                        part = np.asarray(place[at:at + BATCH])
                        n = int(np.searchsorted(self.symbols(part), end))
                        if n:
                            yield part[:n], np.asarray(prefix[at:at + n])
                        at += n
                        if n < len(part):
                            return
                self.one_symbol(i, blocks())
            else:
                part = np.asarray(place[at:at + int(self.bounds_room(i))])
                n = int(np.searchsorted(self.symbols(part), end))
                self.range_of_symbols(i, part[:n], np.asarray(prefix[at:at + n]))
                at += n
        return self.place[:self.found], self.prefix[:self.found]

    def bounds_room(self, i: int) -> int:
        return max(SMALL, min(BATCH, len(self.text) // 16)) + 1


def symbol_ranges(counts: np.ndarray, most: int, scratch: Scratch) -> np.ndarray:
    """Bounds of ranges of symbols with at most ``most`` suffixes; a symbol with more has a range of its own."""
    bounds, ends = [0], np.cumsum(counts, out=scratch.array(len(counts), np.int64))
    while bounds[-1] < len(counts):
        start = bounds[-1]
        below = int(ends[start - 1]) if start else 0
        bounds.append(max(start + 1, int(np.searchsorted(ends, below + most, side="right"))))
    return np.array(bounds)


def seed_places(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Begins of rising runs behind falling ones, and the end mark, in text order."""
    found, right = [np.array([len(text) - 1])], None
    for start in reversed(range(0, len(text), 1 << 22)):
        part = np.asarray(text[max(start - 1, 0):start + (1 << 22) + 1])
        change = np.flatnonzero(part[1:] != part[:-1])
        rising = part[change + 1] > part[change]
        if len(change):
            # a run that begins at change[k] + 1 is a seed if it falls there and rises at the next change
            following = np.append(rising[1:], right if right is not None else False)
            seeds = change[~rising & following] + 1 + max(start - 1, 0)
            found.append(seeds[seeds >= start] if start else seeds)
            right = bool(rising[0])
    whole = np.unique(np.concatenate(found[::-1]))
    places = scratch.array(len(whole), np.int64)
    places[:] = whole
    return places


def packed(text: np.ndarray, place: np.ndarray, left: np.ndarray, offset: int, bits: int, end: int) -> np.ndarray:
    """The next symbols of substrings in one number; behind an end comes the largest number."""
    key = np.zeros(len(place), np.int64)
    for t in range(offset, offset + 62 // bits):
        inside = t < left
        key = key << bits | np.where(inside, text[np.where(inside, place + t, 0)], end)
    return key


def named(text: np.ndarray, places: np.ndarray, symbols: int, scratch: Scratch) -> tuple[np.ndarray, int]:
    """Rank of the substring from each seed to the next one, equal ones having one rank, and the number of ranks.

    Substrings are dealt by ranges of their first symbols, so a range is what is held at once.
    """
    bits, n = int(symbols).bit_length(), len(places)
    step, names, given = 62 // bits, scratch.array(n, np.int32), 0
    sample = np.asarray(places[::max(1, n // 4096)])
    most = max(scratch.memory // 256, SMALL)

    def lengths(start: int, stop: int) -> np.ndarray:
        ends = np.append(places[start + 1:stop + 1], places[-1:] if stop == n else places[:0])
        return ends - places[start:stop] + 1

    cuts = np.sort(packed(text, sample, np.minimum(len(text) - sample, step), 0, bits, symbols))[::max(1, len(sample) * most // max(n, 1))]
    bounds = np.unique(np.concatenate([[0], cuts[1:], [1 << 62]])) if n > most else np.array([0, 1 << 62])
    queue = PriorityQueue(scratch, bounds)
    for start in range(0, n, BATCH):
        stop = min(n, start + BATCH)
        key = packed(text, np.asarray(places[start:stop]), lengths(start, stop), 0, bits, symbols)
        order = np.argsort(key, kind="stable")
        queue.push(tuples(key[order], start + order, np.zeros(stop - start)))
    for i in range(len(bounds) - 1):
        rows = queue.take(i)
        if not len(rows):
            continue
        item = rows["place"]
        place = places[item]
        left = np.where(item + 1 < n, places[np.minimum(item + 1, n - 1)], places[-1]) - place + 1
        new, offset = np.concatenate([[True], rows["symbol"][1:] != rows["symbol"][:-1]]), step
        while True:
            # items of a tie whose substrings go on, sorted by their next symbols within the tie
            group = np.cumsum(new) - 1
            tied = ~new | np.append(~new[1:], False)
            active = np.flatnonzero(tied & (left > offset))
            if not len(active):
                break
            longer = np.zeros(group[-1] + 1, bool)
            longer[group[active]] = True
            active = np.flatnonzero(tied & longer[group])
            key = packed(text, place[active], left[active], offset, bits, symbols)
            order = np.lexsort((key, group[active]))
            for column in (item, place, left):
                column[active] = column[active[order]]
            key, own = key[order], group[active]
            new[active] = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
            offset += step
        names[item] = given + np.cumsum(new) - 1
        given += int(new.sum())
    return names, given


def extended(text: np.ndarray, one: np.ndarray, other: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes that are known to share some symbols."""
    length = np.minimum(known, cap)
    active = np.flatnonzero(length < cap)
    while len(active):
        active = active[text[one[active] + length[active]] == text[other[active] + length[active]]]
        length[active] += 1
        active = active[length[active] < cap]
    return length


def small_order(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    rank, width = np.unique(text, return_inverse=True)[1], 1
    while True:
        behind = np.append(rank[width:], np.full(min(width, len(rank)), -1))
        order = np.lexsort((behind, rank))
        step = (rank[order][1:] != rank[order][:-1]) | (behind[order][1:] != behind[order][:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(step)])
        if step.all():
            break
        width *= 2
    prefix = np.zeros(len(order), np.int64)
    prefix[1:] = extended(text, order[:-1], order[1:], np.zeros(len(order) - 1, np.int64), cap)
    return order, prefix.astype(np.int16)


def sorted_suffixes(text: np.ndarray, symbols: int, cap: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of a text over 0..symbols-1 that ends with its only 0, and the symbols (``cap`` at most)
    that each shares with the one before it."""
    n = len(text)
    if n <= SMALL:
        return small_order(np.asarray(text), cap)
    places = seed_places(text, scratch)
    names, different = named(text, places, symbols, scratch)
    if different == len(places):
        order, shared = scratch.array(different, np.int64), scratch.array(different, np.int16, 0)
        order[names] = np.arange(different)
    else:
        order, shared = sorted_suffixes(names, different, cap, scratch)
    seeds, prefix = scratch.array(len(order), np.int64), scratch.array(len(order), np.int16, 0)
    for start in range(0, len(order), BATCH):
        at = np.asarray(order[start:start + BATCH])
        seeds[start:start + len(at)] = places[at]
        before = np.concatenate([order[start - 1:start] if start else at[:1], at[:-1]])
        known = places[np.minimum(at + shared[start:start + len(at)], len(places) - 1)] - places[at]
        if not start:
            at, before, known = at[1:], before[1:], known[1:]
        prefix[max(start, 1):start + BATCH] = extended(text, places[at], places[before], known, cap)
    counts = scratch.array(symbols, np.int64, 0)
    for start in range(0, n, 1 << 22):
        own, times = np.unique(text[start:start + (1 << 22)], return_counts=True)
        counts[own] += times
    falling, falling_prefix = Scan(text, counts, False, cap, scratch, n).run(seeds, prefix)
    seeds, down = falling_seeds(text, falling, falling_prefix, cap, scratch)
    rising, rising_prefix = Scan(text, counts, True, cap, scratch, n).run(seeds, down)
    upwards = scratch.array(len(rising), np.int16, 0)
    upwards[1:] = rising_prefix[:0:-1]
    return merged(text, counts, falling, falling_prefix, rising[::-1], upwards, cap, scratch)


def falling_seeds(
    text: np.ndarray, falling: np.ndarray, prefix: np.ndarray, cap: int, scratch: Scratch,
) -> tuple[np.ndarray, np.ndarray]:
    """Falling suffixes behind a smaller symbol, from the largest down, with the prefix each shares with the one above."""
    seeds, shared = scratch.array(len(falling), np.int64), scratch.array(len(falling) + 1, np.int16, 0)
    n, carried = 0, cap
    for start in range(0, len(falling), BATCH):
        place, own = np.asarray(falling[start:start + BATCH]), np.asarray(prefix[start:start + BATCH])
        at = np.flatnonzero(place > 0)
        at = at[text[place[at] - 1] < text[place[at]]]
        if len(at):
            least = chosen_prefixes(own, at)
            least[0] = min(int(least[0]), carried)
            seeds[n:n + len(at)], shared[n:n + len(at)] = place[at], least
            n, carried, own = n + len(at), cap, own[at[-1] + 1:]
        carried = min(carried, int(own.min())) if len(own) else carried
    shared[n] = 0  # nothing is above the largest; downwards, the others share with the one above what it shares with them
    return seeds[:n][::-1], shared[1:n + 1][::-1]


def merged(text, counts, falling, falling_prefix, rising, rising_prefix, cap, scratch) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol the falling suffixes, then the rising ones; the end mark is first."""
    order, prefix = scratch.array(len(text), np.int64), scratch.array(len(text), np.int16)
    order[0], prefix[0] = len(text) - 1, 0
    done, f, r = 1, 0, 0
    scan = Scan(text, counts, False, cap, scratch, 0)
    for begin, end in zip(scan.bounds[:-1], scan.bounds[1:], strict=True):
        f2 = f + first_at_least(text, falling, f, end)
        r2 = r + first_at_least(text, rising, r, end)
        if end - begin == 1:
            order[done:done + f2 - f], prefix[done:done + f2 - f] = falling[f:f2], falling_prefix[f:f2]
            done += f2 - f
            order[done:done + r2 - r], prefix[done:done + r2 - r] = rising[r:r2], rising_prefix[r:r2]
            if f2 > f and r2 > r:
                prefix[done] = np.minimum(*scan.run_length(np.array([falling[f2 - 1], rising[r]])))
            done, f, r = done + r2 - r, f2, r2
            continue
        place = np.concatenate([falling[f:f2], rising[r:r2]])
        shared = np.concatenate([falling_prefix[f:f2], rising_prefix[r:r2]])
        symbol = text[place].astype(np.int64)
        by = np.argsort(2 * symbol + (np.arange(len(place)) >= f2 - f), kind="stable")
        kind = (by >= f2 - f)
        place, shared, symbol = place[by], shared[by], symbol[by]
        meet = np.flatnonzero(kind[1:] & ~kind[:-1] & (symbol[1:] == symbol[:-1])) + 1
        shared[meet] = np.minimum(scan.run_length(place[meet - 1]), scan.run_length(place[meet]))
        order[done:done + len(place)], prefix[done:done + len(place)] = place, shared
        done, f, r = done + len(place), f2, r2
    return order, prefix


def first_at_least(text: np.ndarray, places: np.ndarray, start: int, end: int) -> int:
    """How many suffixes, sorted from ``start`` on, begin with a symbol below ``end``."""
    low, high = start, len(places)
    while low < high:
        middle = (low + high) // 2
        if text[places[middle]] < end:
            low = middle + 1
        else:
            high = middle
    return low - start
