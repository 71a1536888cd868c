"""Operators 11 to 13 against plain restatements, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import exact_dedup, log_reassembly, vector_codes

# ------------------------------------------------------------------ 13


def groups(data):
    by = {}
    for d, t in data:
        by.setdefault(t or "", []).append(d)
    out = []
    for t, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        once = [i == keep and k == ids.index(keep) for k, i in enumerate(ids)]
        out += [(i, keep, len(ids), o, hashlib.sha256(t.encode()).hexdigest()) for i, o in zip(ids, once)]
    return sorted(out, key=str)


def found(df, **how):
    return sorted((tuple(r) for r in exact_dedup.exact_groups(df, **how).collect()), key=str)


def test_exact_groups_of_short_blocks(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(40))) for _ in range(60)]
    data = [(i, r.choice(texts) if i % 7 else None) for i in range(90)] + [(3, "x"), (3, "x"), (3, "y"), (None, "y"), (None, "z"), (None, "z"), (500, "é" * 33), (501, "é" * 33 + "e"), (502, "ab" * 5000), (503, "ab" * 5000), (504, "ab" * 4999 + "aa")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("name", F.lit(1))
    assert found(df.repartition(5), size=3) == groups(data)
    assert found(df, size=4096) == groups(data)


def test_unlike_blocks_under_one_key_are_told_apart(spark, monkeypatch):
    data = [(i, chr(97 + i % 26) * (1 + i % 3)) for i in range(60)]
    seeds = []
    plain = exact_dedup.first_names
    monkeypatch.setattr(exact_dedup, "first_names", lambda docs, size, seed, bits: seeds.append(seed) or plain(docs, size, seed, bits if seed > 1 else 2))
    monkeypatch.setattr(exact_dedup, "block_key", lambda b, seed, bits=64, key=exact_dedup.block_key: key(b, seed, bits if seed > 1 else 2))
    assert found(spark.createDataFrame(data, "doc_id long, text string"), size=2) == groups(data)
    assert seeds == [0, 1, 2]


def test_exact_groups_of_nothing(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


# ------------------------------------------------------------------ 12


def replay(log, per_epoch):
    """Record by record, as a database would."""
    store, open_, out, commits, ids = {}, {}, [], 0, sorted(log)
    state = lambda e: out.append(("state", e, len(store), sum(store.values())))
    for at, stream, kind, key, value in ids:
        changes, saved = open_.setdefault(stream, ([], []))
        if kind == "change":
            changes.append((at, key, value))
        elif kind == "savepoint":
            saved[:] = [len(changes)]
        elif kind == "rollback":
            first = saved[0] if saved else 0
            out += [("rollback", a, at, k) for a, k, _ in changes[first:]]
            del changes[first:]
        else:
            if kind == "abort":
                out += [("abort", a, at, k) for a, k, _ in changes]
            else:
                for _, k, v in changes:
                    store.pop(k, None) if v is None else store.__setitem__(k, v)
                commits += 1
                if commits % per_epoch == 0:
                    state(commits // per_epoch)
            del open_[stream]
    if commits % per_epoch:
        state(commits // per_epoch + 1)
    return sorted(out + [("abort", a, None, k) for changes, _ in open_.values() for a, k, _ in changes], key=str)


def made(n, seed, spread, kinds):
    r = random.Random(seed)
    ids = sorted(r.sample(range(-5, spread), n))
    rows = [(at, r.choice(["=a", "=b", "="]), r.choice(kinds)) for at in ids]
    return [(at, s, k, *((r.randrange(12), r.choice([None, r.randrange(1, 99)])) if k == "change" else (None, None))) for at, s, k in rows]


@pytest.mark.parametrize("seed, bits, kinds", [
    (1, 3, ["change"] * 5 + ["savepoint", "rollback", "commit", "abort"]),
    (2, 3, ["change"] * 9 + ["savepoint", "savepoint", "rollback"] * 3 + ["commit"]),
    (3, 12, ["change"] * 5 + ["savepoint", "rollback", "commit", "abort"]),
])
def test_log_as_replayed(spark, monkeypatch, seed, bits, kinds):
    monkeypatch.setattr(log_reassembly, "BITS", bits)
    log = made(260, seed, 1400, kinds)
    df = spark.createDataFrame(log, "at long, stream string, kind string, key long, value long")
    got = sorted((tuple(r) for r in log_reassembly.reassemble(df.repartition(3), per_epoch=3).collect()), key=str)
    assert got == replay(log, 3)


def test_first_lower():
    r = random.Random(4)
    for n in (1, 2, 3, 64, 65, 200):
        h = np.array([r.randrange(6) for _ in range(n)])
        start, bound = np.array([r.randrange(n + 1) for _ in range(50)]), np.array([r.randrange(8) for _ in range(50)])
        want = [next((j for j in range(s, n) if h[j] < b), n) for s, b in zip(start, bound)]
        assert log_reassembly.first_lower(h, start, bound).tolist() == want


def test_records_of_documents(spark):
    h = lambda i: zlib.crc32(str(i).encode())
    change = next(i for i in range(99) if h(i) % 17 > 6)
    toxic, empty, long = (next(i for i in range(k, k + 99) if h(i) % 17 > 6) for k in (200, 400, 600))
    docs = spark.createDataFrame([(change, "s", None), (toxic, "s", "t"), (empty, None, ""), (long, "s", "é" * 100_000), (None, "s", "t"), (change, "s", None), (long, "s", None)], "doc_id long, source string, text string")
    labels = spark.createDataFrame([(toxic, 1), (toxic, 1), (empty, 0), (None, 1), (-1, 1)], "doc_id long, toxic int")
    got = {r["at"]: (r["stream"], r["kind"], r["key"], r["value"]) for r in log_reassembly.log_records(docs, labels).collect()}
    key = lambda i: h(i) // 100 % 30000
    assert got == {change: ("=s", "change", key(change), None), toxic: ("=s", "change", key(toxic), None), empty: ("", "change", key(empty), zlib.crc32(f"{key(empty)}:".encode())), long: ("=s", "change", key(long), None)}
    nothing = log_reassembly.reassemble(log_reassembly.log_records(docs.where("false"), labels))
    assert nothing.collect() == []


# ------------------------------------------------------------------ 11


def plain_codes(vectors, rounds=4, entries=256):
    whole = {v: np.floor(np.array(x, np.float64) * 1024).astype(np.int64) for v, x in vectors.items()}
    parts = {v: np.split(x, 4) for v, x in whole.items()}
    ids = sorted(whole)
    books = [[parts[v][p].tolist() for v in ids[:entries]] for p in range(4)]
    near = lambda p, x: min((sum((int(a) - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(4):
            held = {}
            for v in ids:
                held.setdefault(near(p, parts[v][p])[1], []).append(parts[v][p].tolist())
            new.append([[sum(c) // len(held[e]) for c in zip(*held[e])] if e in held else c for e, c in enumerate(books[p])])
        books = new
    out = {v: [near(p, parts[v][p]) for p in range(4)] for v in ids}
    joined = ",".join(str(x) for b in books for c in b for x in c)
    return {v: ("".join(f"{e:02x}" for _, e in m), sum(d for d, _ in m)) for v, m in out.items()}, hashlib.sha256(joined.encode()).hexdigest()


def test_codes_as_counted_out(spark):
    r = random.Random(8)
    vectors = {i: [r.choice([-0.5, 0.25, r.uniform(-1, 1)]) for _ in range(8)] for i in range(300)}
    vectors |= {300 + i: [0.0] * 8 for i in range(20)}
    label = lambda i: None if i % 5 == 0 else i % 3
    rows = [(i, x, label(i)) for i, x in vectors.items()]
    bad = [(-1, None, 1), (-2, [1.0, None] * 4, 1), (-3, [float("nan")] * 8, 1), (-4, [float("inf")] + [0.0] * 7, None), (-5, [], 2)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("clash"))
    got = {x["vec_id"]: x for x in vector_codes.compressed(df.repartition(6)).collect()}
    want, sha = plain_codes(vectors)
    assert {v: (x["code"], x["error"]) for v, x in got.items()} == want
    assert {x["codebooks_sha256"] for x in got.values()} == {sha}
    sums = {}
    for v, (_, e) in want.items():
        sums[label(v)] = sums.get(label(v), 0) + e
    assert all(x["label_error"] == sums[label(v)] for v, x in got.items())


def test_tree_gives_what_all_distances_give():
    r = np.random.default_rng(3)
    for width, reach in ((1, 5), (4, 3), (16, 900), (16, vector_codes.LARGEST)):
        book = r.integers(-reach, reach + 1, (256, width))
        book[100:110] = book[3]
        points = np.concatenate([r.integers(-reach, reach + 1, (500, width)), book])
        index, best = vector_codes.nearest(vector_codes.ball(book, np.arange(256)), book, points)
        every = ((points[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        assert (best == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()


def test_few_vectors_repeated_ids_and_none(spark):
    df = spark.createDataFrame([(1, [0.5] * 4, 1), (1, [0.25] * 4, 1), (None, [0.0] * 4, None)], "vec_id long, embedding array<float>, label int")
    got = sorted(((r["vec_id"], r["code"], r["error"]) for r in vector_codes.compressed(df).collect()), key=str)
    assert got == [(1, "00000000", 0), (1, "01010101", 0), (None, "02020202", 0)]
    assert vector_codes.compressed(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        vector_codes.codebooks(df.select("vec_id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), "label"))
