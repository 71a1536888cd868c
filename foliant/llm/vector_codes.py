"""Vector code compression: every vector as the indexes of its parts' nearest codebook entries.

Codebooks are refined in a few rounds over all vectors. A task searches the entries of a part position in
a ball tree. Bounds are computed in floats and rounded so that they never promise too much; a ball is
passed over only if its bound is strictly beyond the best distance, and every distance that
decides is a sum of integers, ties going to the lower index. Sums and counts of entries are
added up in each task, so what is shuffled and what the driver sees is as large as the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import bounded, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries in a leaf of the tree, and the relative error allowed to square roots and their sums.
LEAF, SLACK = 32, 1e-9
#: Points that are measured against a leaf at a time.
STEP = 4096
#: Largest integer component: its squared distances stay exact in 64 bits, and exact as doubles up to 2^53.
LARGEST = 1 << 22


# ------------------------------------------------------------------ ball tree


@dataclass
class Ball:
    centre: np.ndarray
    radius: float
    entries: np.ndarray  # of a leaf: indexes in ascending order
    inside: tuple[Ball, Ball] | None = None


def ball(book: np.ndarray, entries: np.ndarray) -> Ball:
    """A ball around some entries; split at the median along the widest axis while more than LEAF are in it."""
    points = book[entries].astype(np.float64)
    centre = points.mean(axis=0)
    far = float(np.sqrt(((points - centre) ** 2).sum(axis=1)).max())
    radius = np.nextafter(far * (1 + SLACK), np.inf)
    if len(entries) <= LEAF or far == 0.0:
        return Ball(centre, radius, np.sort(entries))
    along = points[:, np.argmax(np.ptp(points, axis=0))]
    order = entries[np.argsort(along, kind="stable")]
    half = len(order) // 2
    return Ball(centre, radius, entries, (ball(book, order[:half]), ball(book, order[half:])))


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of integer points to integer entries, exact.

    Where no sum can reach 2^53 every double on the way is a whole number, and one matrix product gives them all.
    """
    reach = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * reach * reach * points.shape[1] < 1 << 53:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2.0 * (p @ e.T) + (e * e).sum(axis=1)[None, :]).astype(np.int64)
    return ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def nearest(tree: Ball, book: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each point's nearest entry, ties to the lower index."""
    index, best = np.full(len(points), len(book), np.int64), np.full(len(points), np.iinfo(np.int64).max, np.int64)
    exact = points.astype(np.float64)

    def distance(node: Ball, which: np.ndarray) -> np.ndarray:
        return np.sqrt(((exact[which] - node.centre) ** 2).sum(axis=1))

    def visit(node: Ball, which: np.ndarray, away: np.ndarray) -> None:
        least = away * (1 - SLACK) - node.radius  # no entry of the ball is nearer
        open_ = least <= np.sqrt(best[which].astype(np.float64)) * (1 + SLACK)
        which = which[open_]
        if not len(which):
            return
        if node.inside is None:
            entries = book[node.entries]
            for a in range(0, len(which), STEP):
                w = which[a : a + STEP]
                d = squared(points[w], entries)
                k = d.argmin(axis=1)
                d, i = d[np.arange(len(w)), k], node.entries[k]
                better = (d < best[w]) | ((d == best[w]) & (i < index[w]))
                best[w[better]], index[w[better]] = d[better], i[better]
            return
        left, right = node.inside
        to_left, to_right = distance(left, which), distance(right, which)
        near = to_left <= to_right
        for first, second, a, b, own in ((left, right, to_left, to_right, near), (right, left, to_right, to_left, ~near)):
            if own.any():
                visit(first, which[own], a[own])
                visit(second, which[own], b[own])

    if len(book) and len(points):
        every = np.arange(len(points))
        visit(tree, every, distance(tree, every))
    return index, best


# ------------------------------------------------------------------ vectors


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one width as integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    whole = np.floor(flat * SCALE)
    if whole.size and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}")
    return whole.astype(np.int64)


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null or empty and holds no null, NaN or infinite component."""
    ok = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return rows.where(F.coalesce(ok, F.lit(False)))


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """Each part of the vectors with the smallest vec_ids, at most `entries` of them; rows that repeat a vec_id by their vectors, ids that are null last."""
    first = rows.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    widths = {len(r["embedding"]) for r in first}
    if not first:
        return []
    if len(widths) > 1 or next(iter(widths)) % parts:
        raise ValueError(f"vectors need one length that {parts} parts divide, not {sorted(widths)}")
    width = widths.pop()
    found = _matrix(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), width)
    return [p.copy() for p in np.split(found, parts, axis=1)]


def _split(batch: pa.RecordBatch, books: list[np.ndarray]) -> list[np.ndarray]:
    column = batch.column(batch.schema.names.index("embedding"))
    width = sum(b.shape[1] for b in books)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != width).any():
        raise ValueError(f"vectors need one length: {width}, not {sorted(set(lengths.tolist()))}")
    return np.split(_matrix(column, width), len(books), axis=1)


def _sums(books: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: (part, entry, count, sums) of the parts that each entry is nearest to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [ball(b, np.arange(len(b))) for b in books]
        sums = [np.zeros((len(b), b.shape[1]), np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for k, points in enumerate(_split(batch, books)):
                index, _ = nearest(trees[k], books[k], points)
                np.add.at(sums[k], index, points)
                counts[k] += np.bincount(index, minlength=len(books[k]))
        part = np.repeat(np.arange(len(books)), [len(b) for b in books])
        entry = np.concatenate([np.arange(len(b)) for b in books])
        used = np.concatenate(counts) > 0
        rows = [s.tolist() for s in np.concatenate(sums)[used]]
        yield pa.RecordBatch.from_arrays([pa.array(part[used], pa.int32()), pa.array(entry[used], pa.int32()), pa.array(np.concatenate(counts)[used], pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return work


def refined(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round; entries that no part is nearest to stay as they are."""
    width = books[0].shape[1]
    partial = rows.select("embedding").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    out = [b.copy() for b in books]
    for r in total.collect():  # as many rows as there are entries
        out[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def _codes(books: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [ball(b, np.arange(len(b))) for b in books]
        for batch in batches:
            found = [nearest(t, b, p) for t, b, p in zip(trees, books, _split(batch, books))]
            code = np.stack([i for i, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            n, step = batch.num_rows, 2 * len(books)
            error = sum(d for _, d in found)
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([batch.column(names.index("vec_id")), batch.column(names.index("label")), pa.array([code[i * step : (i + 1) * step] for i in range(n)], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return work


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One integer codebook (entries by width) for each part position; none if rows is empty."""
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = refined(rows, books)
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of every row: two hex digits a part, and the squared distances summed."""
    label = rows.schema["label"].dataType.simpleString()
    vec_id = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {vec_id}, label {label}, code string, error long"
    if not books:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.select("vec_id", "label", "embedding").mapInArrow(_codes(books), schema)


def compressed(embeddings: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): every vector of whole_vectors in code.

    Vectors must have one length, a multiple of PARTS, and components within LARGEST / SCALE;
    others raise ValueError. Fewer than ENTRIES vectors make smaller codebooks. Rows that repeat a
    vec_id are rows of their own, and so are those without one. An empty table gives no rows.
    """
    rows = whole_vectors(embeddings.select("vec_id", "embedding", "label"))
    books = codebooks(rows)
    coded = written(encode(rows, books), "vector-codes")
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    out = coded.join(bounded(labels), F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
