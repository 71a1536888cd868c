"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import offsets, partitions, range_of, sampled_splitters

P = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_117)
BLOCK = 1 << 16
GRID = 64


def _powers(base: int) -> np.ndarray:
    out = np.ones(BLOCK, np.uint64)
    n = 1
    while n < BLOCK:
        out[n : 2 * n] = out[:n] * np.uint64(pow(base, n, P)) % np.uint64(P)
        n *= 2
    return out


_POW = [_powers(b) for b in BASES]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Modular prefix arrays of a text: H[i] = sum of (c[j] + 1) * B^j for j < i, for two bases.

    Any two spans are compared in constant time by scaling the one that starts earlier;
    the longest common extension of two positions is found by binary search over spans.
    """

    def __init__(self, text: str):
        c = code_points(text).astype(np.uint64) + np.uint64(1)
        self.n = len(c)
        self.h = []
        for base, power in zip(BASES, _POW):
            out, carry, scale, step = np.zeros(self.n + 1, np.uint64), 0, 1, pow(base, BLOCK, P)
            for at in range(0, self.n, BLOCK):
                part = c[at : at + BLOCK]
                terms = part * power[: len(part)] % np.uint64(P) * np.uint64(scale) % np.uint64(P)
                run = (np.cumsum(terms) + np.uint64(carry)) % np.uint64(P)
                out[at + 1 : at + 1 + len(part)] = run
                carry, scale = int(run[-1]), scale * step % P
            self.h.append(out)

    def span(self, i: int, j: int) -> tuple[int, int]:
        return tuple((int(h[j]) - int(h[i])) % P for h in self.h)

    def equal(self, other: PrefixHash, i: int, k: int, length: int) -> bool:
        """Whether self[i:i+length] equals other[k:k+length]."""
        a, b = self.span(i, i + length), other.span(k, k + length)
        return all(x * pow(base, max(0, k - i), P) % P == y * pow(base, max(0, i - k), P) % P for x, y, base in zip(a, b, BASES))

    def lce(self, other: PrefixHash, i: int, k: int) -> int:
        """Length of the longest common extension of self[i:] and other[k:]."""
        lo, hi = 0, min(self.n - i, other.n - k)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(other, i, k, mid) else (lo, mid - 1)
        return lo


def _sums(c: np.ndarray, step: int) -> list[list[int]]:
    """Prefix hashes of c at the multiples of step (and its end), per base, in bounded memory."""
    out: list[list[int]] = []
    for base, power in zip(BASES, _POW):
        sums, carry, scale, jump = [], 0, 1, pow(base, BLOCK, P)
        for at in range(0, len(c), BLOCK):
            part = c[at : at + BLOCK].astype(np.uint64) + np.uint64(1)
            terms = part * power[: len(part)] % np.uint64(P)
            cuts = np.add.reduceat(terms, np.arange(0, len(part), min(step, BLOCK))) % np.uint64(P)
            for k, x in enumerate(cuts.tolist(), 1):
                carry = (carry + x * scale) % P
                if (at + k * min(step, BLOCK)) % step == 0:
                    sums.append(carry)
            scale = scale * jump % P
        if len(c) % step:
            sums.append(carry)
        out.append(sums)
    return out


def grid_step(n: int) -> int:
    """The smallest power of two that cuts n code points into at most GRID blocks."""
    return 1 << max(0, (max(n, 1) - 1) // GRID).bit_length()


def fingerprint(text: str) -> str:
    """`n:whole:prefixes:suffixes` of a text, at most about 1.1 kB, equal for equal texts.

    whole is the 62-bit hash of all code points. prefixes are the prefix array of the first base
    read at the multiples of grid_step(n); suffixes are the same of the reversed text, so that
    what follows an insertion can be matched from the end.
    """
    c = code_points(text)
    step = grid_step(len(c))
    parts = []
    whole = ""
    for way in (c, c[::-1]):
        a, b = _sums(way, step)
        whole = whole or (f"{a[-1]:08x}{b[-1]:08x}" if a else "0" * 16)
        parts.append("".join(f"{x:08x}" for x in a[: len(c) // step]))
    return f"{len(c)}:{whole}:{parts[0]}:{parts[1]}"


def _equal_spans(a: str, b: str, step_a: int, step_b: int, step: int) -> list[int]:
    """The numbers of the blocks of `step` that two prefix grids have equal: the differences of their ends are."""
    ends = lambda s, own: np.array([0, *(int(s[8 * k - 8 : 8 * k], 16) for k in range(step // own, len(s) // 8 + 1, step // own))], np.int64)
    x, y = ends(a, step_a), ends(b, step_b)
    n = min(len(x), len(y))
    return np.flatnonzero(np.diff(x[:n]) % P == np.diff(y[:n]) % P).tolist()


def likeness(a: str, b: str) -> float:
    """The share of the longer text that two fingerprints show to be common, 0 to 1.

    Spans between grid points are equal if the differences of their prefix hashes are: those
    at the same distance from the start, and those at the same distance from the end, each
    place counting once.
    """
    (na, wa, pa_, sa), (nb, wb, pb, sb) = a.split(":"), b.split(":")
    if (na, wa) == (nb, wb):
        return 1.0
    n, m = int(na), int(nb)
    own = grid_step(n), grid_step(m)
    step = max(own)
    head, tail = (_equal_spans(x, y, *own, step) for x, y in ((pa_, pb), (sa, sb)))
    held = set(tail)
    both = sum(max(0, min((i + 1) * step, n - j * step) - max(i * step, n - (j + 1) * step)) for i in head for j in _meets(i, n, step, held))
    return min((len(head) + len(tail)) * step - both, n, m) / max(n, m)


def _meets(i: int, n: int, step: int, tail: set[int]) -> list[int]:
    """Those of tail whose block, counted from the end, may overlap block i from the start."""
    at = (n - (i + 1) * step) // step
    return [j for j in (at - 1, at, at + 1) if j in tail]


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id: int | None, text: str, print_: str, following: str, next_print: str) -> tuple:
    new = edited(text, following)
    edited_print = fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), print_, edited_print, likeness(print_, edited_print), likeness(print_, next_print)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, in order; a bucket's last row (`ahead`) only serves the one before it."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    held = None  # bucket, doc_id, text, fingerprint of the row before; None after an ahead row
    for batch in batches:
        rows = []
        for bucket, ahead, doc_id, text in zip(batch["bucket"].to_pylist(), batch["ahead"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            if ahead and (held is None or held[0] != bucket):
                continue  # further equal ids of the next bucket
            print_ = fingerprint(text)
            if held is not None and held[0] == bucket:
                rows.append(_row(*held[1:], text, print_))
            held = None if ahead else (bucket, doc_id, text, print_)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: fingerprint of the text and of its edited text, and their likeness.

    The edit needs the next text by ascending doc_id. Splitters of a doc_id sample deal
    the rows into buckets (one shuffle of the texts); the first row of each bucket is also
    sent to the bucket before it, the very first to the last. Each bucket is then streamed
    in order, holding two texts at a time.

    A null text counts as empty, a null doc_id comes first; equal doc_ids are ordered by
    text. The only row of a table is its own next row. No rows give no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    least = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(least))
    ids = rows.select(key.alias("key"), F.lit(1).alias("one"))
    cuts = sampled_splitters(ids, ["key"], "one", 4 * partitions(spark))
    bucket = range_of([key], cuts)
    found = rows.groupBy(bucket.alias("b")).agg(F.min(key).alias("k")).orderBy("b").collect()  # as many as buckets
    # the bucket that has to see the first row of each bucket, by that row's key
    to = {r["k"]: found[i - 1]["b"] for i, r in enumerate(found)}
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("ahead"))
    targets = spark.createDataFrame([(k, b) for k, b in to.items()] or [(least, 0)], "first long, to int")
    dealt = rows.join(F.broadcast(targets), key == F.col("first"), "left")
    more = F.when(F.col("first").isNotNull(), F.array(own, F.struct(F.col("to").alias("bucket"), F.lit(True).alias("ahead")))).otherwise(F.array(own))
    dealt = dealt.select("doc_id", "text", F.explode(more).alias("d")).select("d.bucket", "d.ahead", "doc_id", "text")
    order = [F.col("bucket"), F.col("ahead"), F.col("doc_id").asc_nulls_first(), F.col("text")]
    return dealt.repartition(partitions(spark), "bucket").sortWithinPartitions(*order).mapInArrow(_stream, OUT)
