"""External suffix sorting by induction: queues, text and orders live on disk beyond a budget.

A suffix is L-type if it is larger than the next one, else S-type; the S-type suffixes
that follow an L-type one (LMS) are sorted first: their substrings are sorted by one
induction and named, and the string of names is sorted by recursion, until the names fit
in memory, where prefix doubling sorts them.  Then a rising sweep induces all L-type
suffixes and a falling one all S-type.

Each sweep takes suffixes in order from a priority queue whose priority is the first
symbol, equal symbols first in, first out; what leaves the queue puts its predecessor
in.  Tuples are (position, longest common prefix with the tuple before, up to
``depth``); a batch of them is handled at once, the common prefixes by range minima.

``memory`` is what a sort may hold, whatever the text's length: a queue holds a sixteenth
of it and keeps the rest in a scratch file, batches are bounded, and every array that
grows with the text is mapped from a scratch file once it passes a thirty-second.
Scratch files are unnamed files of the task, which the system removes with it.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

#: Bytes that a sort may hold, unless told otherwise.
MEMORY = 64 << 20
#: Bytes of memory for each name that prefix doubling sorts.
NAME_BYTES = 40


class Budget:
    """What a sort may hold, and what it did beyond that."""

    def __init__(self, memory: int = MEMORY, base: int | None = None):
        self.queue, self.array, self.batch = memory // 16, memory // 32, max(64, memory >> 8)
        self.base = memory // NAME_BYTES if base is None else base
        self.spilled = self.mapped = self.recursions = 0

    def zeros(self, n: int, kind) -> np.ndarray:
        """An array, in a scratch file if it is large."""
        size = n * np.dtype(kind).itemsize
        if size <= self.array:
            return np.zeros(n, kind)
        self.mapped += size
        return np.memmap(tempfile.TemporaryFile(prefix="suffix-"), kind, "w+", shape=(n,))

    def parts(self, n: int, most: int | None = None) -> Iterator[tuple[int, int]]:
        """(from, to) of batches of 0 .. n."""
        step = most or 4 * self.batch
        for at in range(0, n, step):
            yield at, min(n, at + step)


class Queue:
    """Tuples by symbol, taken from the front or the back; spills whole runs when it is too full."""

    def __init__(self, budget: Budget):
        self.budget, self.used, self.file = budget, 0, None
        self.held: dict[int, deque] = {}

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        if not len(at):
            return
        self.held.setdefault(symbol, deque()).append((at, lcp))
        self.used += at.nbytes + lcp.nbytes
        if self.used > self.budget.queue:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="queue-")
        place = self.file.seek(0, 2)
        for runs in self.held.values():
            for k, run in enumerate(runs):
                if len(run) == 2:
                    self.file.write(run[0].tobytes())
                    self.file.write(run[1].tobytes())
                    runs[k] = (place, len(run[0]), run[0].dtype)
                    place += run[0].nbytes + run[1].nbytes
        self.budget.spilled += self.used
        self.used = 0

    def _read(self, run: tuple) -> tuple[np.ndarray, np.ndarray]:
        if len(run) == 2:
            self.used -= run[0].nbytes + run[1].nbytes
            return run
        place, n, kind = run
        self.file.seek(place)
        return np.frombuffer(self.file.read(n * kind.itemsize), kind), np.frombuffer(self.file.read(n), np.uint8)

    def take(self, symbol: int, last: bool = False, turned: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """About a batch of a symbol's tuples from the front or the back, runs in the order in which they came or turned."""
        runs = self.held.get(symbol)
        if not runs:
            self.held.pop(symbol, None)
            return None
        out, n = [], 0
        while runs and n < self.budget.batch:
            out.append(self._read(runs.pop() if last else runs.popleft()))
            n += len(out[-1][0])
        if len(out) == 1:
            return out[0]
        if last and not turned:
            out.reverse()
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def types(text: np.ndarray, budget: Budget) -> np.ndarray:
    """True where the suffix is S-type; the last symbol is a smallest, unique end."""
    n = len(text)
    small = budget.zeros(n, bool)
    small[n - 1] = True
    following, kind = int(text[n - 1]), True
    for a, b in reversed(list(budget.parts(n - 1))):
        own = text[a : b + 1].astype(np.int64)
        own[-1] = following
        step = np.sign(np.diff(own))
        # A symbol equal to the next one is of the next one's type.
        at = np.where(step != 0, np.arange(b - a), b - a)
        after = np.minimum.accumulate(at[::-1])[::-1]
        small[a:b] = np.where(after < b - a, step[np.minimum(after, b - a - 1)] > 0, kind)
        following, kind = int(own[0]), bool(small[a])
    return small


def _between(lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(lcp[a + 1 .. b]) for each pair, by doubling."""
    out = np.empty(len(a), np.uint8)
    if not len(a):
        return out
    size = b - a
    level = np.frexp(size)[1] - 1
    table, width = lcp, 1
    for k in range(int(level.max()) + 1):
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[a[own] + 1], table[b[own] + 1 - width])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


class _Sweep:
    """One direction of induction: feeds batches in order and queues predecessors of one type."""

    def __init__(self, text: np.ndarray, small: np.ndarray, wanted: bool, symbols: int, depth: int, budget: Budget):
        self.text, self.small, self.wanted, self.depth = text, small, wanted, depth
        self.queue = Queue(budget)
        # The smallest common prefix since the last tuple for each symbol; none before the first.
        self.since = np.zeros(symbols if depth else 0, np.uint8)
        self.started = np.zeros(symbols if depth else 0, bool)

    def feed(self, at: np.ndarray, lcp: np.ndarray) -> None:
        before = at - 1
        use = np.flatnonzero(at > 0)
        use = use[np.asarray(self.small[before[use]]) == self.wanted]
        depth, since = self.depth, self.since
        if not len(use):
            if depth and len(lcp):
                np.minimum(since, lcp.min(), out=since)
            return
        symbol = np.asarray(self.text[before[use]])
        order = np.argsort(symbol, kind="stable")
        use, symbol = use[order], symbol[order]
        cuts = np.flatnonzero(np.diff(symbol.astype(np.int64))) + 1
        firsts = np.concatenate([[0], cuts])
        lasts = np.concatenate([cuts, [len(use)]]) - 1
        heads = symbol[firsts].astype(np.int64)
        own = np.zeros(len(use), np.uint8)
        if depth:
            first = np.ones(len(use), bool)
            first[1:] = symbol[1:] != symbol[:-1]
            later = np.flatnonzero(~first)
            near = _between(lcp, use[later - 1], use[later])
            own[later] = np.minimum(near, depth - 1) + 1
            lead = np.minimum.accumulate(lcp)
            # A symbol's very first tuple has nothing before it.
            own[firsts] = np.where(self.started[heads], np.minimum(np.minimum(since[heads], lead[use[firsts]]), depth - 1) + 1, 0)
            np.minimum(since, lead[-1], out=since)
            tail = np.minimum.accumulate(lcp[::-1])[::-1]
            end = use[lasts] + 1
            since[heads] = np.where(end < len(lcp), tail[np.minimum(end, len(lcp) - 1)], 255)
            self.started[heads] = True
        went = before[use]
        for head, a, b in zip(heads.tolist(), firsts.tolist(), (lasts + 1).tolist(), strict=True):
            self.queue.push(head, went[a:b], own[a:b])


def _run_common(text: np.ndarray, i: int, j: int, depth: int) -> int:
    """Common prefix of two suffixes, up to depth."""
    n = min(depth, len(text) - i, len(text) - j)
    differ = np.flatnonzero(text[i : i + n] != text[j : j + n])
    return int(differ[0]) if len(differ) else n


def _heads(text: np.ndarray, budget: Budget) -> np.ndarray:
    """The symbols of a text, in order."""
    found = np.zeros(0, np.int64)
    for a, b in budget.parts(len(text)):
        found = np.union1d(found, text[a:b])
    return found.astype(np.int64)


def _groups(text: np.ndarray, lms: np.ndarray, budget: Budget) -> dict[int, tuple[int, int]]:
    """(from, to) among sorted LMS positions of each first symbol."""
    out: dict[int, tuple[int, int]] = {}
    for a, b in budget.parts(len(lms)):
        head = np.asarray(text[lms[a:b]]).astype(np.int64)
        cuts = np.flatnonzero(np.diff(head)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b - a], strict=True):
            c = int(head[i])
            out[c] = (out[c][0] if c in out else a + i, a + j)
    return out


def induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, lms_lcp: np.ndarray | None, depth: int, budget: Budget):
    """Batches (positions, common prefixes with the tuple before) of all suffixes in order.

    ``lms`` are the sorted LMS suffixes and ``lms_lcp`` their common prefixes with the one
    before; ``depth`` 0 leaves common prefixes out.  A symbol's first suffix has 0.
    """
    present = _heads(text, budget)
    symbols = int(present[-1]) + 1
    present = present.tolist()
    stars = _groups(text, lms, budget)
    none = np.zeros(0, np.uint8)
    rising = _Sweep(text, small, False, symbols, depth, budget)
    large = Queue(budget)
    for c in present:
        last = -1
        while (got := rising.queue.take(c)) is not None:
            large.push(c, *got)
            rising.feed(*got)
            last = int(got[0][-1])
        if c in stars:
            begin, end = stars[c]
            for a, b in budget.parts(end - begin, budget.batch):
                pos = np.asarray(lms[begin + a : begin + b])
                lcp = np.array(lms_lcp[begin + a : begin + b]) if depth else np.zeros(len(pos), np.uint8)
                if depth and not a:
                    lcp[0] = _run_common(text, last, int(pos[0]), depth) if last >= 0 else 0
                rising.feed(pos, lcp)
    del rising
    falling = _Sweep(text, small, True, symbols, depth, budget)
    out = Queue(budget)
    kind = lms.dtype
    for c in reversed(present):
        # Falling order: each tuple's common prefix is that with the tuple taken before it.
        last = -1
        while (got := falling.queue.take(c)) is not None:
            out.push(2 * c + 1, *got)
            falling.feed(*got)
            last = int(got[0][-1])
        carry = None
        while (got := large.take(c, last=True)) is not None:
            pos, lcp = got
            out.push(2 * c, pos, lcp)
            back = np.zeros(len(lcp), np.uint8)
            if depth:
                back[1:] = lcp[:0:-1]
                back[0] = carry if carry is not None else _run_common(text, last, int(pos[-1]), depth) if last >= 0 else 0
                carry = int(lcp[0])
            falling.feed(pos[::-1], back)
        if c == present[0]:
            out.push(2 * c + 1, np.array([len(text) - 1], kind), np.zeros(1, np.uint8))
    del falling, large
    for c in present:
        last = -1
        while (got := out.take(2 * c, last=True, turned=True)) is not None:  # the falling sweep met them back to front
            yield got
            last = int(got[0][-1])
        carry = None
        while (got := out.take(2 * c + 1, last=True)) is not None:
            pos, lcp = got[0][::-1], got[1]
            up = none
            if depth:
                up = np.zeros(len(lcp), np.uint8)
                up[1:] = lcp[:0:-1]
                up[0] = carry if carry is not None else _run_common(text, last, int(pos[0]), depth) if last >= 0 else 0
                carry = int(lcp[0])
            yield pos, up


def double(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, to ``depth`` symbols, by prefix doubling."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    size = 1
    while size < depth:
        second = np.zeros(n, np.int64)
        second[: n - size] = rank[size:] if size < n else 0
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank[order] = np.cumsum(new)
        if new.all() or size >= n:
            break
        size *= 2
    return order


def common(text: np.ndarray, order: np.ndarray, depth: int, budget: Budget) -> np.ndarray:
    """Common prefixes, up to depth, of neighbours in ``order``."""
    out, n = budget.zeros(len(order), np.uint8), len(text)
    for begin, end in budget.parts(max(0, len(order) - 1)):
        own = np.asarray(order[begin : end + 1])
        a, b = own[:-1], own[1:]
        found, left = np.zeros(len(a), np.uint8), np.arange(len(a))
        for k in range(depth):
            i, j = a[left] + k, b[left] + k
            fits = (i < n) & (j < n)
            left, i, j = left[fits], i[fits], j[fits]
            left = left[np.asarray(text[i]) == np.asarray(text[j])]
            if not len(left):
                break
            found[left] = k + 1
        out[begin + 1 : end + 1] = found
    return out


def lms_places(small: np.ndarray, budget: Budget) -> np.ndarray:
    """Positions of LMS suffixes, rising."""
    found = [np.flatnonzero(small[a + 1 : b + 1] & ~small[a:b]) + a + 1 for a, b in budget.parts(len(small) - 1)] if len(small) * 3 <= budget.array else None
    kind = np.int32 if len(small) < 1 << 31 else np.int64
    if found is not None:
        return np.concatenate(found or [np.zeros(0)]).astype(kind)
    counts = [int(np.count_nonzero(small[a + 1 : b + 1] & ~small[a:b])) for a, b in budget.parts(len(small) - 1)]
    out, at = budget.zeros(sum(counts), kind), 0
    for (a, b), n in zip(budget.parts(len(small) - 1), counts, strict=True):
        out[at : at + n] = np.flatnonzero(small[a + 1 : b + 1] & ~small[a:b]) + a + 1
        at += n
    return out


def _by_symbol(text: np.ndarray, places: np.ndarray, budget: Budget) -> np.ndarray:
    """``places`` in the order of their first symbols, equal ones as they are."""
    queue, out = Queue(budget), budget.zeros(len(places), places.dtype)
    for a, b in budget.parts(len(places), budget.batch):
        own = np.asarray(places[a:b])
        head = np.asarray(text[own]).astype(np.int64)
        order = np.argsort(head, kind="stable")
        own, head = own[order], head[order]
        cuts = np.flatnonzero(np.diff(head)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)], strict=True):
            queue.push(int(head[i]), own[i:j], np.zeros(j - i, np.uint8))
    at = 0
    for c in sorted(queue.held):
        while (got := queue.take(c)) is not None:
            out[at : at + len(got[0])] = got[0]
            at += len(got[0])
    return out


def sorted_lms(text: np.ndarray, small: np.ndarray, depth: int, budget: Budget) -> np.ndarray:
    """LMS positions in the order of their suffixes (to ``depth`` symbols)."""
    lms = lms_places(small, budget)
    if len(lms) < 2:
        return lms
    # Any order within a first symbol will do to sort the substrings.
    is_lms = budget.zeros(len(text), bool)
    for a, b in budget.parts(len(lms)):
        is_lms[lms[a:b]] = True
    order, at = budget.zeros(len(lms), lms.dtype), 0
    for pos, _ in induce(text, small, _by_symbol(text, lms, budget), None, 0, budget):
        own = pos[np.asarray(is_lms[pos])]
        order[at : at + len(own)] = own
        at += len(own)
    # Names: neighbours with equal substrings (to the next LMS symbol, inclusive) share one.
    names, name, repeated = budget.zeros(len(lms), np.int64), 0, False
    for a, b in budget.parts(len(order)):
        own = np.asarray(order[max(0, a - 1) : b])
        where = np.searchsorted(lms, own)
        span = np.where(where + 1 < len(lms), np.asarray(lms[np.minimum(where + 1, len(lms) - 1)]), len(text) - 1) - own + 1
        same = np.zeros(len(own), bool)
        left, k = np.flatnonzero(span[1:] == span[:-1]), 0
        while len(left):
            left = left[np.asarray(text[own[left] + k]) == np.asarray(text[own[left + 1] + k])]
            k += 1
            done = span[left] == k
            same[left[done] + 1] = True
            left = left[~done]
        if a:
            own, where, same = own[1:], where[1:], same[1:]
        repeated |= bool(same.any())
        names[where] = name + np.cumsum(~same)
        name += int(np.count_nonzero(~same))
    if not repeated:
        return order
    if len(names) <= budget.base:
        return lms[double(names, depth // 2 + 2)]
    budget.recursions += 1
    deeper = budget.zeros(len(names) + 1, np.int64)
    deeper[: len(names)] = names
    del names, order
    out, at = budget.zeros(len(lms), lms.dtype), 0
    for pos, _ in ordered(deeper, depth // 2 + 2, budget):
        own = pos[pos < len(lms)]
        out[at : at + len(own)] = lms[own]
        at += len(own)
    return out


def ordered(text: np.ndarray, depth: int, budget: Budget):
    """Batches of the suffixes of ``text`` (unique smallest symbol at its end) in order, to ``depth`` symbols."""
    small = types(text, budget)
    yield from induce(text, small, sorted_lms(text, small, depth, budget), None, 0, budget)


def suffixes(text: np.ndarray, depth: int, budget: Budget | None = None):
    """Yield (positions, common prefixes with the suffix before, up to depth), in order."""
    if not 0 < depth < 255:
        raise ValueError("depth is 1 to 254")
    budget = budget or Budget()
    small = types(text, budget)
    lms = sorted_lms(text, small, depth, budget)
    yield from induce(text, small, lms, common(text, lms, depth, budget), depth, budget)
