"""Substring dedup: shared k-mer seeds, collinear chains, alignment of fuzzy passages."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import words as W
from foliant.llm.common import bounded, partitions, written

K, WINDOW, MARGIN, STEP = 5, 6, 64, 64
GAP = 0.01  # cost of a word of gap, in seeds
MANY, HELD = 16, 1 << 14  # rows of a seed up to which all its documents meet; and that are held until it is complete
TABLE = 1 << 18  # most cells of an alignment table; larger ones are divided


def minimizers(kmers: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the least of some window of k-mers: two equal runs of window + k - 1 words share one."""
    n = len(kmers)
    if n <= window:
        return np.array([kmers.argmin()]) if n else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(kmers, window)
    out = []
    for at in range(0, len(views), 1 << 16):
        out.append(np.unique(views[at : at + (1 << 16)].argmin(axis=1) + np.arange(at, min(len(views), at + (1 << 16)))))
    return np.unique(np.concatenate(out)) if len(out) > 1 else out[0]


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["h", "doc", "pos"]
    for batch in batches:
        hs, ds, ps, held = [], [], [], 0
        ids = batch.column(0).to_pylist()
        for doc, h in zip(ids, W.words(batch.column(1))):
            kmers = W.shingles(h, K, whole=False)
            at = minimizers(kmers, WINDOW)
            if len(at):
                hs.append(kmers[at])
                ds.append(np.full(len(at), doc, np.int64))
                ps.append(at.astype(np.int32))
                held += len(at)
            if held > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(ds)), pa.array(np.concatenate(ps))], names)
                hs, ds, ps, held = [], [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(ds)), pa.array(np.concatenate(ps))], names)


PAIR = "kind int, doc long, partner long, x int, y int"


def _matches(batches: Iterator[pa.RecordBatch], rare: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows come by (h, doc, pos), equal h in one task: each occurrence meets those in all earlier documents.

    Of an h with more than MANY rows each meets the first document, a single seed also the
    one before its own, and comes out again (kind 1: doc, h, pos, last) to be joined with what follows it.
    The rows of other h of several documents come out as kind 2, if asked for (rare).
    """
    names = ["kind", "doc", "partner", "x", "y"]

    def pack(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
        types = [pa.int64()] * 2 + [pa.int32()] * 2
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind), pa.int32()), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    def both(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        """Rows i meet rows j, with their first seeds and, of several, with their last ones."""
        several = last[i] > pos[i]
        i2, j2 = i[several], j[several]
        return pack(0, doc[np.r_[i, i2]], doc[np.r_[j, j2]], np.r_[pos[i], last[i2]], np.r_[pos[j], last[j2]])

    rest, seen, big = [np.zeros(0, np.int64)] * 4, 0, False  # the open group, rows of it that had their turn, whether it had to be taken as frequent
    for batch in chain(batches, iter([None])):
        new = [np.zeros(0, np.int64)] * 4 if batch is None else [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
        h, doc, pos, last = (np.concatenate(c) for c in zip(rest, new))
        if not len(h):
            continue
        opens = np.concatenate([[True], h[1:] != h[:-1]])
        start = np.flatnonzero(opens)
        size = np.diff(np.r_[start, len(h)])
        group = np.cumsum(opens) - 1
        turns = opens | np.concatenate([[True], doc[1:] != doc[:-1]])
        shared = np.add.reduceat(turns.astype(np.int64), start) > 1
        many = (size > MANY) & shared  # what is in one document alone meets nothing
        forced = batch is not None and (size[-1] > HELD or (big and len(start) == 1))
        many[0] |= big
        many[-1] |= forced
        rows = np.arange(seen, len(h) if batch is None or forced else start[-1])
        i, back = rows[~many[group[rows]] & (size[group[rows]] <= MANY)], 1
        if rare and len(k := i[shared[group[i]]]):
            yield pack(2, doc[k], h[k], pos[k], last[k])
        while len(i := i[i - back >= start[group[i]]]):
            j = i - back
            if len(k := np.flatnonzero(doc[i] != doc[j])):
                yield both(i[k], j[k])
            back += 1
        if len(i := rows[many[group[rows]]]):
            own = np.maximum.accumulate(np.where(turns, np.arange(len(h)), 0))  # first row of the same h and doc
            first, before = start[group[i]], own[i] - 1
            f = doc[first] != doc[i]
            g = (before > first) & (doc[before] != doc[first]) & (last[i] == pos[i])
            if f.any() or g.any():
                yield both(np.r_[i[f], i[g]], np.r_[first[f], before[g]])
            yield pack(1, doc[i], h[i], pos[i], last[i])
        big = forced
        if big:
            at = start[-1]
            other = np.flatnonzero(doc[at:] != doc[-1])
            keep = np.unique([at, at + other[-1] if len(other) else at, len(h) - 1])
        else:
            keep = np.arange(start[-1], len(h))
        rest, seen = [c[keep] for c in (h, doc, pos, last)], len(keep) if big else 0


def _joined(batches: Iterator[pa.RecordBatch], least: int, single: bool) -> Iterator[pa.RecordBatch]:
    """Rows (doc, h, pos, last, rare) come by (doc, pos, last): single seeds with each of the next two, runs with the
    furthest that starts within them or right after, so that they about double; all within `least` words.

    A rare seed right behind or before frequent ones is joined with the nearest of them that makes a
    chain with it: what its documents have in common goes on among the frequent seeds.
    """
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
    rest, reach = none, hull(least) - K
    for batch in chain(batches, iter([None])):
        new = none if batch is None else [batch.column(i).to_numpy(zero_copy_only=False).astype(t.dtype) for i, t in enumerate(none)]
        doc, h, pos, last, rare = (np.concatenate(c) for c in zip(rest, new))
        at = np.flatnonzero(doc != doc[-1])[-1] + 1 if len(doc) and (doc != doc[-1]).any() else 0
        end = len(doc) if batch is None else at
        rest = [c[end:] for c in (doc, h, pos, last, rare)]
        if not end:
            continue
        doc, h, pos, last, rare = (c[:end] for c in (doc, h, pos, last, rare))
        place = (np.cumsum(np.r_[0, np.diff(doc) != 0]) << 32) + pos  # ascending
        often = np.flatnonzero(~rare)
        if not len(often):
            continue
        if single:
            after = np.flatnonzero(rare[1:] & ~rare[:-1]) + 1
            before = np.flatnonzero(rare[:-1] & ~rare[1:])
            left = np.searchsorted(place[often], place[after] - reach, side="right") - 1
            right = np.searchsorted(place[often], place[before] + reach)
            after, left = after[left >= 0], often[left[left >= 0]]
            before, right = before[right < len(often)], often[right[right < len(often)]]
            i, j = np.r_[often[:-1], often[:-2], left, before], np.r_[often[1:], often[2:], after, right]
        else:
            i = np.arange(end)
            j = np.searchsorted(place, place + np.minimum(last - pos + 2 * K, least - K), side="right") - 1
            while (far := (j > i) & (last[j] + K - pos > least)).any():  # back to one that ends within `least` words
                j = np.where(far, j - 1, j)
        i, j = i[last[j] > last[i]], j[last[j] > last[i]]
        near = (doc[i] == doc[j]) & (np.maximum(last[i], last[j]) + K - pos[i] <= least)
        i, j = i[near], j[near]
        if len(i):
            with np.errstate(over="ignore"):
                key = W.mix(W.mix(h[i].view(np.uint64), 1) * np.uint64(3) + h[j].view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc[i]), pa.array(pos[i].astype(np.int32)), pa.array(np.maximum(last[i], last[j]).astype(np.int32))], ["h", "doc", "pos", "last"])


def hull(least: int) -> int:
    """Words from the first to the last seed that make a chain worth aligning for passages of `least` words."""
    return max(2 * K, least // 3)


def met(seeds: DataFrame, least: int, n: int) -> DataFrame:
    """(doc, partner, x, y): equal seeds of two documents, frequent ones also through the runs of seeds they are part of."""
    rows, out, single = seeds.withColumn("last", F.col("pos")), None, True
    while True:
        dealt = rows.repartition(n, "h").sortWithinPartitions("h", "doc", "pos", "last")
        found = written(dealt.mapInArrow(lambda b, single=single: _matches(b, single), PAIR), "matches")
        pairs = found.where("kind = 0").select("doc", "partner", "x", "y")
        out = pairs if out is None else out.unionByName(pairs)
        if found.where("kind = 1").isEmpty():
            return out
        many = found.where("kind > 0").select("doc", F.col("partner").alias("h"), F.col("x").alias("pos"), F.col("y").alias("last"), (F.col("kind") == 2).alias("rare")).repartition(n, "doc").sortWithinPartitions("doc", "pos", "last")
        rows, single = many.mapInArrow(lambda b, single=single: _joined(b, least, single), "h long, doc long, pos int, last int"), False


class Fenwick:
    """Prefix maxima of (value, index)."""

    def __init__(self, n: int):
        self.t = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, v: tuple[float, int]) -> None:
        i += 1
        while i < len(self.t):
            if v > self.t[i]:
                self.t[i] = v
            i += i & -i

    def best(self, i: int) -> tuple[float, int]:
        """Over indices below i."""
        out = (-1e18, -1)
        while i > 0:
            if self.t[i] > out:
                out = self.t[i]
            i -= i & -i
        return out


def chains(x: np.ndarray, y: np.ndarray, gap: float = GAP) -> list[np.ndarray]:
    """Disjoint collinear chains of at least two matches, as index arrays; best first.

    x is sorted (then y). A chain ascends in both; a step costs `gap` per word skipped on
    either side, so f(i) = 1 + max(0, f(j) - gap * (x[i] - x[j] + y[i] - y[j])), the maximum
    over earlier matches with lesser y coming from a Fenwick tree over the ranks of y.
    """
    n = len(x)
    if n < 2:
        return []
    if (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and ((np.diff(x) + np.diff(y)) * gap < 1).all():
        return [np.arange(n)]  # already one chain, each step worth taking
    rank = np.unique(y, return_inverse=True)[1]
    tree, f, prev = Fenwick(int(rank.max()) + 1), np.zeros(n), np.full(n, -1)
    i = 0
    while i < n:
        k = i
        while k < n and x[k] == x[i]:  # equal x do not follow each other
            value, j = tree.best(int(rank[k]))
            gain = value - gap * float(x[k] + y[k])
            f[k], prev[k] = (1 + gain, j) if j >= 0 and gain > 0 else (1.0, -1)
            k += 1
        for m in range(i, k):
            tree.put(int(rank[m]), (f[m] + gap * float(x[m] + y[m]), m))
        i = k
    used, out = np.zeros(n, bool), []
    for end in np.argsort(-f, kind="stable"):
        path, j = [], int(end)
        while j >= 0 and not used[j]:
            path.append(j)
            j = int(prev[j])
        used[path] = True
        if len(path) > 1:
            out.append(np.array(path[::-1]))
    return out


CHAIN = ["doc", "partner", "x0", "x1", "y0", "y1", "sx", "sy", "leads"]
TYPES = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.list_(pa.int32())] * 2 + [pa.bool_()]


class Spans:
    """Stretches of one document, and how much of another stretch the best of them covers."""

    def __init__(self):
        self.rows, self.n = np.zeros((8, 2), np.int64), 0

    def add(self, start: int, end: int) -> None:
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n], self.n = (start, end), self.n + 1

    def cover(self, start: int, end: int) -> bool:
        """Whether nine tenths lie within one of them."""
        low, high = self.rows[: self.n].T
        return bool((np.minimum(high, end) - np.maximum(low, start)).max(initial=0) >= 0.9 * (end - start))


def _chained(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows come by (doc, partner, x, y). All of a document's chains that are long enough on both sides; those lead
    that do not lie nine tenths within one of more seeds. The matches of one pair are held at a time, and a document's chains."""

    def pair(doc: int, partner: int, x: np.ndarray, y: np.ndarray) -> Iterator[tuple]:
        fresh = np.concatenate([[True], (np.diff(x) != 0) | (np.diff(y) != 0)])
        x, y = x[fresh], y[fresh]
        if min(x[-1] - x[0], y.max() - y.min()) + K < least:
            return
        for c in chains(x, y):
            xs, ys = x[c], y[c]
            if min(xs[-1] - xs[0], ys[-1] - ys[0]) + K >= least:
                yield doc, partner, int(xs[0]), int(xs[-1]) + K, int(ys[0]), int(ys[-1]) + K, xs, ys

    def led(found: list[tuple]) -> list[tuple]:
        spans, rows = Spans(), []
        for r in sorted(found, key=lambda r: (-len(r[6]), r[1:6])):
            leads = not spans.cover(r[2], r[3])
            if leads:
                spans.add(r[2], r[3])
            rows.append((*r, leads))
        return rows

    have, parts, found = None, [], []  # the open pair, its matches, its document's chains
    for batch in chain(batches, iter([None])):
        new = None if batch is None else [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
        if new is not None and not len(new[0]):
            continue
        rows: list[tuple] = []
        cut = [0] if new is None else np.concatenate([[0], np.flatnonzero((np.diff(new[0]) != 0) | (np.diff(new[1]) != 0)) + 1, [len(new[0])]]).tolist()
        for a, b in zip(cut, [*cut[1:], None]):
            if b is None and new is not None:
                break
            at = None if b is None else (int(new[0][a]), int(new[1][a]))
            if at != have and have is not None:
                found += pair(*have, *(np.concatenate(c) for c in zip(*parts)))
                parts = []
                if at is None or at[0] != have[0]:
                    rows, found = rows + led(found), []
            have = at
            if at is not None:
                parts.append((new[2][a:b], new[3][a:b]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], CHAIN)


def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (doc, kind): verified passages (kind 0), then chains (kind 1). Those chains of which no passage covers nine tenths."""
    have, spans = None, Spans()
    for batch in batches:
        doc, kind, x0, x1 = (batch.column(i).to_pylist() for i in range(4))
        keep = np.zeros(len(doc), bool)
        for i, d in enumerate(doc):
            if d != have:
                have, spans = d, Spans()
            if kind[i] == 0:
                spans.add(x0[i], x1[i])
            else:
                keep[i] = not spans.cover(x0[i], x1[i])
        if keep.any():
            yield batch.filter(pa.array(keep))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (doc, kind): a text, then the (lo, hi) asked of it. Gives 32-bit word hashes."""
    have, words = None, np.zeros(0, np.uint64)
    schema = pa.schema([("doc", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("ws", pa.list_(pa.int32()))])
    for batch in batches:
        doc, kind, lo, hi = (batch.column(i).to_pylist() for i in (0, 1, 2, 3))
        text = batch.column(4)
        rows, size = [], 0
        for i, d in enumerate(doc):
            if kind[i] == 0:
                if d != have:  # of repeated ids the text with the least hash
                    have, words = d, next(W.words(text.slice(i, 1))).astype(np.uint32).view(np.int32)
            elif d == have:
                rows.append((d, lo[i], hi[i], words[lo[i] : hi[i]]))
                size += hi[i] - lo[i]
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _extend(same: np.ndarray, penalty: float = 2.0, drop: float = 24.0) -> tuple[int, int]:
    """(length, matches) of the best prefix of a row of matches and mismatches, given up `drop` below its best."""
    if not len(same):
        return 0, 0
    score = np.cumsum(np.where(same, 1.0, -penalty))
    low = np.flatnonzero(np.maximum(np.maximum.accumulate(score), 0) - score > drop)
    score = score[: low[0]] if len(low) else score
    if not len(score) or score.max() <= 0:
        return 0, 0
    n = int(score.argmax()) + 1
    return n, int(same[:n].sum())


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a with each prefix of b."""
    t = np.zeros(len(b) + 1, np.int32)
    for w in a:
        t[1:] = np.maximum(t[1:], t[:-1] + (b == w))
        np.maximum.accumulate(t, out=t)
    return t


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and in b of a longest common subsequence; what is too long for a table is divided in two (Hirschberg)."""
    n, m = len(a), len(b)
    if n > 1 and (n + 1) * (m + 1) > TABLE:
        half = n // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        (x0, y0), (x1, y1) = common(a[:half], b[:cut]), common(a[half:], b[cut:])
        return np.concatenate([x0, x1 + half]), np.concatenate([y0, y1 + cut])
    t = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n):
        t[i + 1, 1:] = np.maximum(t[i, 1:], t[i, :-1] + (b == a[i]))
        np.maximum.accumulate(t[i + 1], out=t[i + 1])
    xs, ys, i, j = [], [], n, m
    while t[i, j]:
        if t[i, j] == t[i - 1, j]:
            i -= 1
        elif t[i, j] == t[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            xs.append(i)
            ys.append(j)
    return np.array(xs[::-1], np.int64), np.array(ys[::-1], np.int64)


def between(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words of two stretches between seeds: on the diagonal if few differ, else by the longest common subsequence."""
    if len(a) == len(b) and (same := np.flatnonzero(a == b)).size >= len(a) - 2:
        return same, same
    return common(a, b)


def path(a: np.ndarray, b: np.ndarray, sx: np.ndarray, sy: np.ndarray, ends: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions of equal words, aligned along a chain of seeds and beyond its ends: on the diagonal, or freely (ends)."""
    turn = np.flatnonzero(np.concatenate([[True], np.diff(sx) != np.diff(sy), [True]]))
    step = []  # where seeds leave the diagonal, or more than two words differ between two
    for s, e in zip(turn[:-1], turn[1:]):
        wrong = np.concatenate([[0], np.cumsum(a[sx[s] : sx[e - 1]] != b[sy[s] : sy[e - 1]])])[sx[s:e] - sx[s]]
        step += [s, *(s + 1 + np.flatnonzero(np.diff(wrong) > 2))]
    xs, ys, x, y = [], [], 0, 0
    for i, (s, e) in enumerate(zip(step, [*step[1:], len(sx)])):
        x0, y0 = int(sx[s]), int(sy[s])
        cut = max(0, x - x0, y - y0)  # words that an earlier seed has already
        x0, y0, x1 = x0 + cut, y0 + cut, int(sx[e - 1]) + K
        if i:
            u, v = between(a[x:x0], b[y:y0])
            xs.append(u + x)
            ys.append(v + y)
        elif ends:
            lo, to = max(0, x0 - MARGIN), max(0, y0 - MARGIN)
            u, v = common(a[lo:x0], b[to:y0])
            xs.append(u + lo)
            ys.append(v + to)
        else:
            n = min(x0, y0)
            back, _ = _extend((a[x0 - n : x0] == b[y0 - n : y0])[::-1])
            u = np.flatnonzero(a[x0 - back : x0] == b[y0 - back : y0])
            xs.append(u + x0 - back)
            ys.append(u + y0 - back)
        u = np.flatnonzero(a[x0:x1] == b[y0 : y0 + x1 - x0])
        xs.append(u + x0)
        ys.append(u + y0)
        x, y = x1, y0 + x1 - x0
    n = min(len(a) - x, len(b) - y)
    if ends:
        u, v = common(a[x : x + MARGIN], b[y : y + MARGIN])
    else:
        on, _ = _extend(a[x : x + n] == b[y : y + n])
        u = v = np.flatnonzero(a[x : x + on] == b[y : y + on])
    return np.concatenate([*xs, u + x]), np.concatenate([*ys, v + y])


def maximal(score: np.ndarray) -> list[tuple[int, int]]:
    """All maximal-scoring runs of a row of numbers as (first, last) (Ruzzo and Tompa)."""
    out: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, s in enumerate(score.tolist()):
        low, total = total, total + s
        if s <= 0:
            continue
        first = i
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= low:
                j -= 1
            if j < 0 or out[j][3] >= total:
                break
            first, low = out[j][0], out[j][2]
            del out[j:]
        out.append((first, i, low, total))
    return [(a, b) for a, b, _, _ in out]


def passages(x: np.ndarray, y: np.ndarray, least: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """(x0, x1, y0, y1, matches) of the stretches of an alignment that are long and alike enough.

    x and y are the equal words. Stretches are maximal with a match worth 1 and a word
    between costing half of what it would at the identity asked for; what is not alike
    enough is cut again at a higher cost, and at last its longest alike stretch is taken.
    """
    skip = np.maximum(np.diff(x), np.diff(y)) - 1
    cut = np.concatenate([[0], np.flatnonzero(skip) + 1, [len(x)]])
    size, gap = np.diff(cut), skip[cut[1:-1] - 1]  # runs of equal words, and the words between them
    full = identity / max(1 - identity, 1e-9)

    def measured(i: int, j: int) -> tuple[int, int, int, int, int]:
        s, e = cut[i], cut[j + 1] - 1
        return int(x[s]), int(x[e]) + 1, int(y[s]), int(y[e]) + 1, int(e - s + 1)

    def good(r: tuple) -> bool:
        return min(r[1] - r[0], r[3] - r[2]) >= least and r[4] >= identity * max(r[1] - r[0], r[3] - r[2])

    def search(i: int, j: int, costs: tuple) -> list[tuple]:
        whole = measured(i, j)
        if min(whole[1] - whole[0], whole[3] - whole[2]) < least:
            return []
        if costs:
            score = np.empty(2 * (j - i) + 1)
            score[::2], score[1::2] = size[i : j + 1], -costs[0] * gap[i:j]
            out = []
            for a, b in maximal(score):
                r = measured(i + a // 2, i + b // 2)
                out += [r] if good(r) else search(i + a // 2, i + b // 2, costs[1:])
            if out:
                return out
        return longest(i, j)

    def longest(i: int, j: int) -> list[tuple]:
        """The longest run of runs of i to j that is alike enough."""
        up = np.concatenate([[0], np.cumsum(size[i : j + 1] - full * np.concatenate([gap[i:j], [0]]))])
        best = None
        least_from = np.maximum.accumulate((up[1:] + full * np.concatenate([gap[i:j], [0]]))[::-1])[::-1]
        for a in range(j - i + 1):
            b = int(np.searchsorted(-least_from, -up[a] + 1e-6, side="right")) - 1
            if b >= a and good(r := measured(i + a, i + b)) and (best is None or r[4] > best[4]):
                best = r
        return [best] if best else []

    return search(0, len(size) - 1, (full / 2, full * 0.75, full)) if len(x) else []


def align(a: np.ndarray, b: np.ndarray, sx: np.ndarray, sy: np.ndarray, least: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """Passages along a chain of seeds; if there are none, with ends aligned beyond words left out."""
    if np.isin(a, b).sum() < identity * least or np.isin(b, a).sum() < identity * least:
        return []  # no alignment has enough equal words
    return passages(*path(a, b, sx, sy), least, identity) or passages(*path(a, b, sx, sy, True), least, identity)


RESULT = "doc_id long, partner_id long, start int, end int, partner_start int, partner_end int, matched int, identity double"
NEAR = 32  # words from the end of a slice within which a passage may go on beyond it


def _aligned(batches: Iterator[pa.RecordBatch], least: int, identity: float) -> Iterator[pa.RecordBatch]:
    """Rows (doc, partner, x0, y0, xlo, ylo, xhi, yhi, sx, sy, xs, ys); gives passages, with x0, y0 and whether one of
    the chain's comes near an end of a slice where the text goes on (open)."""
    names = ["doc_id", "partner_id", "start", "end", "partner_start", "partner_end", "matched", "identity", "x0", "y0", "open"]
    types = [pa.int64()] * 2 + [pa.int32()] * 5 + [pa.float64()] + [pa.int32()] * 2 + [pa.bool_()]
    for batch in batches:
        doc, partner, x0, y0, xlo, ylo, xhi, yhi = (batch.column(i).to_pylist() for i in range(8))
        rows = []
        for i in range(batch.num_rows):
            sx, sy, a, b = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (8, 9, 10, 11))
            xl, yl = xlo[i], ylo[i]
            found = align(a, b, sx - xl, sy - yl, least, identity)
            before = any((xl > 0 and s < NEAR) or (yl > 0 and ps < NEAR) for s, _, ps, _, _ in found)
            after = any((len(a) == xhi[i] - xl and e > len(a) - NEAR) or (len(b) == yhi[i] - yl and pe > len(b) - NEAR) for _, e, _, pe, _ in found)
            for s, e, ps, pe, got in found:
                rows.append((doc[i], partner[i], s + xl, e + xl, ps + yl, pe + yl, got, got / max(e - s, pe - ps), x0[i], y0[i], before or after))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)


def with_margin(chained: DataFrame, margin: int) -> DataFrame:
    """Adds what of both texts is asked for, in steps of STEP words: (xlo, xhi), (ylo, yhi)."""
    low = lambda c: (F.floor(F.greatest(F.col(c) - margin, F.lit(0)) / STEP) * STEP).cast("int")
    high = lambda c: (F.ceil((F.col(c) + margin) / STEP) * STEP).cast("int")
    return chained.withColumns({"xlo": low("x0"), "xhi": high("x1"), "ylo": low("y0"), "yhi": high("y1")})


def sliced(rows: DataFrame, chained: DataFrame, n: int) -> DataFrame:
    """(doc, lo, hi, ws): the words that the chains ask for, each stretch once."""
    asked = chained.select("doc", F.col("xlo").alias("lo"), F.col("xhi").alias("hi")).unionByName(chained.select(F.col("partner").alias("doc"), F.col("ylo").alias("lo"), F.col("yhi").alias("hi"))).distinct()
    asked = written(asked.select("doc", F.lit(1).alias("kind"), "lo", "hi", F.lit(None).cast("string").alias("text")), "asked")
    texts = rows.join(bounded(asked.select("doc").distinct()), "doc", "left_semi").select("doc", F.lit(0).alias("kind"), F.hash("text").alias("lo"), F.lit(0).alias("hi"), "text")
    dealt = texts.unionByName(asked).repartition(n, "doc").sortWithinPartitions("doc", "kind", "lo", "hi")
    return written(dealt.mapInArrow(_slices, "doc long, lo int, hi int, ws array<int>"), "slices")


def verified(rows: DataFrame, chained: DataFrame, slices: DataFrame, least: int, identity: float, n: int) -> DataFrame:
    """The passages along chains, aligned on slices; a chain whose passage may go on beyond its slices is aligned again on wider ones."""
    out, margin = None, MARGIN
    while True:
        left = slices.select("doc", F.col("lo").alias("xlo"), F.col("hi").alias("xhi"), F.col("ws").alias("xs"))
        right = slices.select(F.col("doc").alias("partner"), F.col("lo").alias("ylo"), F.col("hi").alias("yhi"), F.col("ws").alias("ys"))
        both = chained.join(left, ["doc", "xlo", "xhi"]).join(right, ["partner", "ylo", "yhi"])
        both = both.select("doc", "partner", "x0", "y0", "xlo", "ylo", "xhi", "yhi", "sx", "sy", "xs", "ys")
        found = written(both.mapInArrow(lambda b: _aligned(b, least, identity), f"{RESULT}, x0 int, y0 int, open boolean"), "passages")
        done = found.where("not open").drop("x0", "y0", "open")
        out = done if out is None else out.unionByName(done)
        wider = found.where("open").select(F.col("doc_id").alias("doc"), F.col("partner_id").alias("partner"), "x0", "y0").distinct()
        if wider.isEmpty():
            return out
        margin *= 64  # few rounds: a text is soon asked for whole
        again = chained.drop("xlo", "xhi", "ylo", "yhi").join(bounded(wider), ["doc", "partner", "x0", "y0"], "left_semi")
        chained = written(with_margin(again, margin), "chains")
        slices = sliced(rows, chained, n)


def repeated_passages(docs: DataFrame, least: int = 50, identity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, partner_id, start, end, partner_start, partner_end, matched, identity): passages that occur in another document.

    Positions count words (runs of characters other than space and \\t to \\r; A-Z
    lower-cased), ends are exclusive. A passage has at least `least` words on both sides
    and at least `identity` of the longer side matches; passages with other words between are
    told apart, by what half the cost of a differing word at that identity joins. partner_id is a document with the
    passage that comes earlier by doc_id, so m documents with one exact passage give m - 1 rows or a
    few more, not all pairs; of a document's verified passages those that lie nine tenths within one
    with more matches are left out. What repeats inside one document alone is not reported.

    Seeds are the minimizers of 5-word runs in windows of 6, so two equal runs of 10 words share a
    seed, and 99 % of 80-word passages with a change every eight words have a chain of seeds (README).
    Equal seeds come to one task and are streamed through it. Up to MANY rows of a seed meet in all
    documents. Of a more frequent seed each row meets the first and the preceding document, and is
    joined with either of the next two frequent seeds, with rare seeds next to it, and such runs with
    each other, until a run has at most MANY rows or would pass `least` words; so a document with the
    same frequent seeds in the same order is met wherever they also occur singly, and one with more
    than the frequent seeds is met through what follows them. Of runs that stay frequent up to `least`
    words only the first document is met. Matches are chained per pair of documents, and the
    chains aligned on slices of both texts, asked for in steps of 64 words so that equal
    requests are made once, and on wider ones where a passage comes near a slice's end. Of the chains
    that cover the same stretch the one with the most seeds is aligned first; the others are, too,
    unless a verified passage covers nine tenths of theirs.

    Rows with a null doc_id or a null or short text have no passages; of rows with equal
    ids the text with the least hash is aligned. No rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    seeds = written(rows.mapInArrow(_seeds, "h long, doc long, pos int"), "seeds")
    by_doc = met(seeds, least, n).repartition(n, "doc").sortWithinPartitions("doc", "partner", "x", "y")
    found = by_doc.mapInArrow(lambda b: _chained(b, hull(least)), "doc long, partner long, x0 int, x1 int, y0 int, y1 int, sx array<int>, sy array<int>, leads boolean")
    found = written(with_margin(found, MARGIN), "chains")
    slices = sliced(rows, found, n)
    # the chains that lead first; of the others those whose stretch has no passage yet
    first = verified(rows, found.where("leads"), slices, least, identity, n)
    others = found.where("not leads").drop("leads")
    names = [c for c in others.columns if c not in ("doc", "x0", "x1")]
    have = first.select(F.col("doc_id").alias("doc"), F.lit(0).alias("kind"), F.col("start").alias("x0"), F.col("end").alias("x1"), *[F.lit(None).cast(others.schema[c].dataType).alias(c) for c in names])
    dealt = have.unionByName(others.withColumn("kind", F.lit(1))).repartition(n, "doc").sortWithinPartitions("doc", "kind")
    rest = written(dealt.mapInArrow(_uncovered, dealt.schema).drop("kind"), "rest")
    every = first.unionByName(verified(rows, rest, slices, least, identity, n))
    ordered = every.repartition(n, "doc_id").sortWithinPartitions("doc_id", F.desc("matched"), "partner_id", "start", "end", "partner_start")
    return ordered.mapInArrow(_best, RESULT)


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (doc, matched from the most, partner, start): without passages nine tenths within ones before them."""
    have, spans = None, Spans()
    for batch in batches:
        doc, start, end = (batch.column(i).to_pylist() for i in (0, 2, 3))
        keep = np.ones(len(doc), bool)
        for i, d in enumerate(doc):
            if d != have:
                have, spans = d, Spans()
            keep[i] = not spans.cover(start[i], end[i])
            if keep[i]:
                spans.add(start[i], end[i])
        if keep.any():
            yield batch.filter(pa.array(keep))
