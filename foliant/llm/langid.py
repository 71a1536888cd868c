"""Language ID: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
PIECE = 1 << 18
ROWS = 1 << 15  # rows of the table that are gathered at a time


@dataclass(frozen=True)
class Settings:
    """buckets may be at most 65536. rows, valid and text_bytes bound what comes to the driver: the labelled documents the model is fitted and calibrated on, and the UTF-8 bytes that a text of them has at most."""

    rows: int = 1500
    valid: int = 400
    text_bytes: int = 1 << 16
    buckets: int = 1 << 15
    dim: int = 16
    epochs: int = 6
    steps: int = 1500
    rate: float = 0.5
    batch: int = 32
    line_chars: int = 20
    rejected: float = 0.001
    floor: float = 0.4
    seed: int = 11


_tables: tuple[np.ndarray, np.ndarray] | None = None


def _chars() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower-case form (where that is one code point), and whether it is a letter."""
    global _tables
    if _tables is None:
        lower, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                letter[i] = True
                low = c.lower()
                lower[i] = ord(low) if len(low) == 1 else i
        _tables = lower, letter
    return _tables


def subwords(c: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of all 1- to 3-grams of the lower-cased letters of a text; any run of other characters is one gap."""
    lower, letter = _chars()
    is_letter = letter[c]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first character after a letter stands for the gap
    x = np.where(is_letter, lower[c], 32)[keep].astype(np.uint64)
    if not x.size:
        return np.zeros(0, np.int64)
    x = np.concatenate([[np.uint64(32)], x])
    out, h = [], np.zeros(len(x), np.uint64)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(x) < n:
                break
            h = h[: len(x) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + x[n - 1 :] * np.uint64(2) + np.uint64(n)
            out.append(((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(buckets))
    return np.concatenate(out).astype(np.int64)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """langs, one row of logits per bucket (embedding times output layer), bias, temperature, threshold."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.langs, self.table, self.bias, self.temperature, self.threshold = langs, table, bias, temperature, threshold

    def logits(self, text: str) -> np.ndarray | None:
        """Of the whole text; None if it has no letter."""
        c = points(text)
        total, n = np.zeros(len(self.langs)), 0
        for at in range(0, len(c), PIECE):
            ids = subwords(c[at : at + PIECE], len(self.table))
            for k in range(0, len(ids), ROWS):
                total += self.table[ids[k : k + ROWS]].sum(axis=0, dtype=np.float64)
            n += len(ids)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language or und, calibrated probability, accepted)."""
        z = self.logits(text) if text else None
        if z is None or not self.langs:
            return "und", 0.0, False
        p = softmax(z / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] >= self.threshold)


def fit(rows: list[tuple[str, str]], settings: Settings = Settings()) -> Model:
    """Stochastic gradient descent over the rows' whole texts and, so that short texts are met, their lines.

    The last `valid` share of the rows is held back: a temperature is chosen there by least
    log loss against targets of (N + 1) / (N + 2), as Platt smooths them, and the threshold
    is the quantile `rejected` of the probability of their right predictions, at most `floor`.
    """
    s, rng = settings, np.random.default_rng(settings.seed)
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0), 1.0, 0.0)
    held = max(1, len(rows) * s.valid // (s.rows + s.valid)) if len(rows) > 4 else 0
    train, valid = rows[: len(rows) - held], rows[len(rows) - held :]
    at = {lang: i for i, lang in enumerate(langs)}
    ids_of, share_of, ends, ys = array("H"), array("f"), [0], []  # bucket numbers and weights of all pieces, end to end
    for text, lang in train:
        lines = [x for x in text.split("\n") if len(x) >= s.line_chars]
        for piece in [text, *(lines[i] for i in rng.permutation(len(lines))[:2])]:
            ids, counts = np.unique(subwords(points(piece), s.buckets), return_counts=True)
            if ids.size:
                ids_of.frombytes(ids.astype(np.uint16).tobytes())
                share_of.frombytes((counts / counts.sum()).astype(np.float32).tobytes())
                ends.append(len(ids_of))
                ys.append(at[lang])
    all_ids, all_shares = np.frombuffer(ids_of, np.uint16) if ys else np.zeros(0, np.uint16), np.frombuffer(share_of, np.float32) if ys else np.zeros(0, np.float32)
    piece = lambda i: (all_ids[ends[i] : ends[i + 1]], all_shares[ends[i] : ends[i + 1]], ys[i])
    emb = rng.normal(0, 0.1, (s.buckets, s.dim)).astype(np.float32)
    out, bias = np.zeros((s.dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    epochs = max(s.epochs, -(-s.steps * s.batch // max(1, len(ys))))  # small tables are gone over more often
    for epoch in range(epochs):
        rate = s.rate * (1 - epoch / epochs)
        order = rng.permutation(len(ys))
        for b in range(0, len(order), s.batch):
            part = [piece(i) for i in order[b : b + s.batch]]
            mean = np.stack([w @ emb[ids] for ids, w, _ in part])
            g = softmax(mean @ out + bias)
            g[np.arange(len(part)), [y for *_, y in part]] -= 1
            back = g @ out.T
            out -= rate * 5 / len(part) * mean.T @ g
            bias -= rate / len(part) * g.sum(axis=0)
            for (ids, w, _), d in zip(part, back):
                emb[ids] -= rate * 20 / len(part) * w[:, None] * d
    model = Model(langs, (emb @ out).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    scored = [(z, at[lang]) for text, lang in valid if (z := model.logits(text)) is not None]
    if scored:
        z, y = np.stack([a for a, _ in scored]), np.array([b for _, b in scored])
        goal = np.full(z.shape, 1 / (len(y) + 2) / max(1, len(langs) - 1))
        goal[np.arange(len(y)), y] = (len(y) + 1) / (len(y) + 2)
        loss = {t: -(goal * np.log(np.maximum(softmax(z / t), 1e-300))).sum(axis=1).mean() for t in np.geomspace(0.05, 5, 41)}
        model.temperature = float(min(loss, key=loss.get))
        p = softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        model.threshold = float(min(s.floor, np.quantile(right, s.rejected))) if right.size else s.floor
    return model


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 = 1; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fits on at most rows + valid labelled documents of at most text_bytes that are not held out, those of least hash.

    Only text and lang are learned from; a null doc_id is not held out.
    """
    usable = docs.where(F.col(lang).isNotNull() & (F.octet_length(text) <= settings.text_bytes) & ~held_out(F.col(doc_id)))
    draw = F.xxhash64(F.lit(settings.seed), doc_id).alias("__h")
    ids = usable.select(F.col(doc_id).alias("__id"), draw).orderBy("__h", "__id").limit(settings.rows + settings.valid)
    last = ids.agg(F.max("__h")).first()[0]
    if last is None:
        return fit([], settings)
    rows = usable.where(F.xxhash64(F.lit(settings.seed), doc_id) <= last).select(text, lang, draw).orderBy("__h", text).limit(settings.rows + settings.valid)
    return fit([(r[text], r[lang]) for r in rows.toLocalIterator()], settings)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs plus lang_pred, score and accepted, each from the row's whole text alone.

    `und`, score 0 and not accepted for a null text or one without letters; otherwise a
    learned language with its calibrated probability, not accepted below the model's
    threshold. Texts are scored in pieces, so memory does not grow with their length.
    No rows give no rows; columns of docs with the three new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            found = [own.predict(t.as_py()) for t in texts]  # one text at a time is a Python string
            columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.StructArray.from_arrays(columns, ["lang_pred", "score", "accepted"])

    judge = F.arrow_udf(run, "lang_pred string, score double, accepted boolean")
    base = docs.drop("lang_pred", "score", "accepted")
    return base.withColumn("__p", judge(F.col(text))).select(*base.columns, "__p.lang_pred", "__p.score", "__p.accepted")
