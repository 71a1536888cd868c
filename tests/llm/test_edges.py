"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from foliant.llm import decontaminate, fingerprints, jaccard_join, langid, line_dedup, mixing, sharding, substring_dedup, url_filter, warc
from foliant.llm.common import components, pick_splitters, range_of

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
PROSE = " ".join(f"{a}{b}" for a in WORDS[:10] for b in WORDS[:12])
LONG = "\n".join(f"{w}{i} " * 40 for i in range(40) for w in WORDS)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, rank int, h long, comp string, w string"


def edge_rows():
    texts = [None, "", " ", PROSE, PROSE, PROSE + " omega", LONG, "x", "été 123", "!!! ???", PROSE.upper()]
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else None, None, 1, "k", 2, 3, "c", "w") for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, PROSE, None, None, None, 1, "k", 2, 3, "c", "w"), (None, None, None, None, None, 1, None, 2, 3, "c", "w")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(0, " ".join(PROSE.split()[20:50])), (1, None), (2, ""), (None, PROSE), (3, "x y")], "item_id long, text string")


def test_fingerprints(docs, none):
    out = fingerprints.fingerprints(docs).collect()
    assert len(out) == len(edge_rows()) and fingerprints.fingerprints(none).count() == 0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert len({r["fingerprint"] for r in out if r["doc_id"] in (3, 4)}) == 1
    assert next(r for r in out if r["doc_id"] == 1)["n_chars"] == 0


def test_one_row_is_its_own_next(spark):
    r = fingerprints.fingerprints(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).first()
    assert (r["doc_id"], r["near_next"]) == (7, 1.0)


def test_prefix_hashes():
    import random

    rng = random.Random(1)
    for n in (0, 1, 5, 300, 70_000):
        a = "".join(rng.choice("abé\U0001f600") for _ in range(n))
        b = a[: n // 2] + "#" + a[n // 2 :]
        x, y = fingerprints.PrefixHash(a), fingerprints.PrefixHash(b)
        assert x.lce(y, 0, 0) == n // 2 and x.lce(y, n // 2, n // 2 + 1) == n - n // 2
        if n > 10:
            assert x.equal(y, n // 2 + 1, n // 2 + 2, 3) and not x.equal(y, n // 2 - 2, n // 2 - 2, 3)
    big = "ab" * 100_000
    assert fingerprints.likeness(fingerprints.fingerprint(big), fingerprints.fingerprint(big[:100_000] + "x" + big[100_000:])) > 0.9
    assert fingerprints.likeness(fingerprints.fingerprint(""), fingerprints.fingerprint("a")) == 0.0


def test_mixing(docs, none):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(edge_rows()) and mixing.mix_sources(none).count() == 0
    assert set(out[0].asDict()) == {*SCHEMA.replace(",", "").split()[::2], "source_size", "target", "copies"}
    assert all(r["size"] == len((r["text"] or "").split()) and 0 <= r["copies"] <= 3 for r in out)
    assert mixing.emit(mixing.mix_sources(docs)).count() == sum(r["copies"] for r in out)


def test_targets_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), ("d", 0), (None, 1)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["d"] == 0 and got[None] == 3 and got["a"] == 30 and got["b"] == 300 and got["c"] == pytest.approx(1111 - 333)


def test_sharding(spark, docs, none):
    def run(df):
        keyed = df.withColumn("key", sharding.shard_key(F.col("text"))).withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long"))
        return sharding.shard(keyed, shards=3).collect()

    out = run(docs)
    assert len(out) == len(edge_rows()) and not run(none)
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    hot = spark.createDataFrame([(i, "same text") for i in range(300)] + [(1000 + i, f"text {i}") for i in range(600)], "doc_id long, text string")
    held = [sum(r["size"] for r in run(hot) if r["shard"] == s) for s in range(3)]
    assert max(held) <= 1.05 * min(held)


def test_native_operators_run_no_python(spark, docs, items):
    for df in (mixing.mix_sources(docs), line_dedup.fuzzy_lines(docs), decontaminate.contaminated(docs, items)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_shared_folder_is_asked_for():
    from types import SimpleNamespace

    from foliant.llm.common import shared_dir

    at = lambda master, path: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: path), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(at("local[4]", None)).startswith("file:/tmp/") and shared_dir(at("spark://a:1", "hdfs:/x/")) == "hdfs:/x"
    for master in ("spark://a:1", "local-cluster[2,1,900]", "yarn"):
        with pytest.raises(ValueError):
            shared_dir(at(master, None))


def test_language(docs, none):
    model = langid.train(docs)
    assert model.langs == ["en"]
    out = langid.identify(docs, model).collect()
    assert {(r["lang_pred"], r["score"]) for r in out if not (r["text"] or "").strip() or r["text"] == "!!! ???"} == {("und", 0.0)}
    assert langid.identify(none, model).count() == 0 and langid.train(none).predict("a")[0] == "und"


def test_language_against_brute_force(docs):
    """Probabilities restated gram by gram, from the model's table."""
    import math

    from foliant.llm.langid import ORDERS

    model = langid.fit([(t, lang) for i in range(40) for t, lang in ((f"the house {i} and the dog", "en"), (f"das haus {i} und der hund", "de"))])
    mask = (1 << 64) - 1

    def plain(text):
        low = [c.lower() if len(c.lower()) == 1 else c for c in text]
        x = [32]
        for i, c in enumerate(low):
            if text[i].isalpha():
                x.append(ord(c))
            elif i == 0 or text[i - 1].isalpha():
                if i or text[i].isalpha():
                    x.append(32)
        grams = []
        for n in ORDERS:
            for at in range(len(x) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 0x9E3779B97F4A7C15 + x[at + k] * 2 + (k + 1)) & mask
                grams.append((h * 0xD6E8FEB86659FD93 & mask) >> 40)
        z = [sum(float(model.table[g % len(model.table)][c]) for g in grams) / len(grams) + float(model.bias[c]) for c in range(len(model.langs))]
        e = [math.exp((v - max(z)) / model.temperature) for v in z]
        return model.langs[e.index(max(e))], max(e) / sum(e)

    for text in ("the dog", "der Hund, das Haus!", "und\n\nand", "x1y", "Éclair"):
        lang, p = plain(text)
        got = model.predict(text)
        assert got[0] == lang and got[1] == pytest.approx(p, rel=1e-5)


def test_jaccard(docs, none):
    out = jaccard_join.jaccard_components(docs).collect()
    assert len(out) == len(edge_rows()) and jaccard_join.jaccard_components(none).count() == 0
    group = {r["doc_id"]: r["component_id"] for r in out}
    assert {group[i] for i in (3, 4, 5, 10)} == {3} and group[0] == 0 and group[1] == 1 and group[2] == 2 and group[None] is None


def test_jaccard_at_random(spark):
    import random

    from tests.llm.test_contracts import brute

    rng = random.Random(9)
    base = [[rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.choice((3, 6, 40, 80)))] for _ in range(12)]
    texts = {}
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts[i] = {"text": " ".join(w)}
    _, want = brute(texts)
    df = spark.createDataFrame([(i, t["text"]) for i, t in texts.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(df).collect()} == want


def test_lines(spark, docs, none):
    out = line_dedup.fuzzy_lines(docs).collect()
    assert len(out) == sum(len(t.split("\n")) for _, t, *_ in edge_rows() if t is not None)
    assert line_dedup.fuzzy_lines(none).count() == 0 and all(r["keep"] for r in out if r["doc_id"] in (1, 2))
    a, b, c = "the quick brown fox jumps over the lazy dog near the river bank today", "the quick brown fox jumps over the lazy dog near the river bank todai", "something else entirely stands here in this line and no other one at all"
    df = spark.createDataFrame([(1, f"{a}\n{c}\nab"), (2, f"{b}\n\nab"), (3, a)], "doc_id long, text string")
    found = line_dedup.fuzzy_lines(df)
    assert {(r["doc_id"], r["line_no"]) for r in found.collect() if not r["keep"]} == {(2, 0), (2, 2), (3, 0)}
    assert {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(df, found).collect()} == {1: f"{a}\n{c}\nab", 2: "", 3: ""}


def test_passages(spark, docs, none):
    out = substring_dedup.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in out} == {4, 5, 10} and substring_dedup.repeated_passages(none).count() == 0
    w = [f"w{i}" for i in range(300)]
    passage = [f"p{i}" for i in range(60)]
    fuzzy = [*passage[:25], "new", *passage[26:40], *passage[41:]]
    df = spark.createDataFrame([(1, " ".join(w[:50] + passage + w[50:90])), (2, " ".join(w[100:130] + fuzzy + w[130:190])), (3, " ".join(w[200:280])), (4, " ".join(passage[:45]))], "doc_id long, text string")
    r = substring_dedup.repeated_passages(df).collect()
    assert len(r) == 1 and (r[0]["doc_id"], r[0]["partner_id"], r[0]["start"], r[0]["end"], r[0]["partner_start"], r[0]["partner_end"]) == (2, 1, 30, 89, 50, 110)


def test_repetitive_lines_of_any_length(spark):
    """Equal shingle sets are alike however often the line repeats them."""
    texts = ["To " * 30, "To " * 70, "-" * 40, "-" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["keep"], r["first_doc"]) for r in line_dedup.fuzzy_lines(df).collect()}
    assert got == {0: (True, 0), 1: (False, 0), 2: (True, 2), 3: (False, 2)}


def random_words(rng, n):
    return [f"r{rng.randrange(10**9)}" for _ in range(n)]


@pytest.mark.parametrize("apart", [50, 100, 200])
def test_two_passages_apart(spark, apart):
    import random

    rng = random.Random(apart)
    p, q = random_words(rng, 60), random_words(rng, 60)
    texts = [random_words(rng, 30) + p + random_words(rng, apart) + q + random_words(rng, 30) for _ in range(2)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    r = substring_dedup.repeated_passages(df).collect()
    assert sorted((x["doc_id"], x["start"], x["end"]) for x in r) == [(1, 30, 90), (1, 90 + apart, 150 + apart)] and all(x["identity"] == 1 for x in r)


def test_exact_passage_within_an_unlike_chain(spark):
    """Document 2 shares more seeds with 0, none of whose passages is long enough, than with 1."""
    import random

    rng = random.Random(8)
    p = [random_words(rng, 40) for _ in range(3)]
    filled = lambda: random_words(rng, 20) + p[0] + random_words(rng, 45) + p[1] + random_words(rng, 45) + p[2] + random_words(rng, 20)
    zero, two = filled(), filled()
    one = random_words(rng, 20) + two[95:155] + random_words(rng, 20)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([zero, one, two])], "doc_id long, text string")
    r = substring_dedup.repeated_passages(df).collect()
    assert [(x["doc_id"], x["partner_id"], x["start"], x["end"]) for x in r] == [(2, 1, 95, 155)]


def test_passage_of_frequent_fragments(spark):
    """Every seed of the passage also occurs singly in many earlier and later documents; only 500 has it whole before 1000."""
    import random

    rng = random.Random(9)
    p = random_words(rng, 60)
    bits = [random_words(rng, 15) + p[i : i + 23] + random_words(rng, 15) for _ in range(14) for i in range(38)]
    rng.shuffle(bits)
    texts = {i if i < 400 else i + 101: w for i, w in enumerate(bits)}
    texts |= {500: random_words(rng, 20) + p + random_words(rng, 20), 1000: random_words(rng, 25) + p + random_words(rng, 20)}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    r = substring_dedup.repeated_passages(df).collect()
    assert [(x["doc_id"], x["partner_id"], x["start"], x["end"]) for x in r] == [(1000, 500, 25, 85)]


def test_passage_goes_on_beyond_its_seeds(spark):
    """60 equal words, then 200 of which every seventh differs: no seed reaches into the tail, the passage does."""
    import random

    rng = random.Random(14)
    p = random_words(rng, 260)
    q = [w if i < 60 or i % 7 else f"other{i}" for i, w in enumerate(p)]
    docs = [random_words(rng, 30) + p + random_words(rng, 300), random_words(rng, 40) + q + random_words(rng, 300)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    r = substring_dedup.repeated_passages(df).collect()
    assert [(x["doc_id"], x["start"]) for x in r] == [(1, 40)] and 295 <= r[0]["end"] <= 301 and r[0]["identity"] > 0.85


def test_halves_do_not_hide_the_whole_passage(spark):
    import random

    rng = random.Random(15)
    p = random_words(rng, 60)
    parts = {1: p[:30], 2: p[30:], 3: p, 4: p[:30], 5: p[30:], 6: p}
    df = spark.createDataFrame([(d, " ".join(random_words(rng, 25) + w + random_words(rng, 25))) for d, w in parts.items()], "doc_id long, text string")
    assert [(x["doc_id"], x["partner_id"], x["start"], x["end"]) for x in substring_dedup.repeated_passages(df).collect()] == [(6, 3, 25, 85)]


def test_passages_at_random_and_any_partitioning(spark):
    """Every document with a run of 50 words that an earlier one has is found, whatever the number of partitions, and no other."""
    import random

    rng = random.Random(16)
    pool = [random_words(rng, 90) for _ in range(6)]
    texts = []
    for _ in range(60):
        w = random_words(rng, rng.randrange(20, 60))
        for _ in range(rng.randrange(3)):
            p, n = rng.choice(pool), rng.randrange(35, 75)
            at = rng.randrange(90 - n)
            w += p[at : at + n] + random_words(rng, rng.randrange(20, 60))
        texts.append(w)

    def runs(w):
        return {tuple(w[i : i + 50]) for i in range(len(w) - 49)}

    want = {i for i, w in enumerate(texts) if any(runs(w) & runs(v) for v in texts[:i])}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(tuple, substring_dedup.repeated_passages(df).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and {r[0] for r in got[0]} == want and len(want) > 20


def test_passage_behind_or_before_a_frequent_stretch(spark):
    """Of a passage of two documents, 55 words are also in 26 others: the whole of it is found, whatever end is frequent."""
    import random

    rng, rows, want = random.Random(17), [], set()
    for trial in range(24):
        common, own, base = random_words(rng, 55), random_words(rng, (20, 28)[trial % 2]), 100 * trial
        p = common + own if trial < 12 else own + common
        rows += [(base + i, random_words(rng, 30) + common + random_words(rng, 30)) for i in range(26)]
        rows += [(base + i, random_words(rng, 30) + p + random_words(rng, 30)) for i in (40, 41)]
        want.add((base + 41, base + 40, 30, 30 + len(p)))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r["doc_id"], r["partner_id"], r["start"], r["end"]) for r in substring_dedup.repeated_passages(df).collect()}
    assert want <= got


def test_recall_of_changed_passages(spark):
    """80 words with a change every 8 to 20 words: nine tenths are found at each distance, most words of each."""
    import random

    rng, rows, steps = random.Random(18), [], (8, 10, 12, 15, 20)
    for k, step in enumerate(steps):
        for i in range(40):
            p, off = random_words(rng, 80), rng.randrange(step)
            q = [w if (j - off) % step else f"other{j}" for j, w in enumerate(p)]
            rows += [(1000 * k + 2 * i, random_words(rng, 40) + p + random_words(rng, 40)), (1000 * k + 2 * i + 1, random_words(rng, 30) + q + random_words(rng, 50))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = substring_dedup.repeated_passages(df).collect()
    assert all(r["doc_id"] == r["partner_id"] + 1 and r["identity"] >= 0.8 for r in found)
    for k in range(len(steps)):
        assert len({r["doc_id"] for r in found if r["doc_id"] // 1000 == k and r["end"] - r["start"] >= 64}) >= 36


def test_repeated_ids_of_passages(spark):
    """Of two texts of one id the same is aligned in every run, in whatever order they come."""
    import random

    rng = random.Random(19)
    p = random_words(rng, 60)
    rows = [(1, p + random_words(rng, 30)), (2, random_words(rng, 30) + p), (2, random_words(rng, 44) + p)]
    got = []
    for r in (rows, rows[::-1]):
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in r], "doc_id long, text string").repartition(1)
        got.append(sorted(map(tuple, substring_dedup.repeated_passages(df).collect())))
    assert got[0] == got[1] and [(r[0], r[1], r[3] - r[2]) for r in got[0]] == [(2, 1, 60)]


def test_common_subsequence_of_long_stretches(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(20)
    for n, m in ((1, 90), (70, 80), (200, 3), (150, 150), (0, 5)):
        a, b = rng.integers(0, 9, n), rng.integers(0, 9, m)
        whole = substring_dedup.common(a, b)
        with monkeypatch.context() as c:
            c.setattr(substring_dedup, "TABLE", 64)
            x, y = substring_dedup.common(a, b)
        assert len(x) == len(whole[0]) and (a[x] == b[y]).all() and (np.diff(x) > 0).all() and (np.diff(y) > 0).all()


def test_matches_across_batches():
    """A seed of two batches and more meets the same documents as in one."""
    import pyarrow as pa

    for n in (3, 16, 17, 40):
        rows = [(7, d // 2, d, d) for d in range(n)]
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 2 + [pa.int32()] * 2)]
        whole = pa.RecordBatch.from_arrays(cols, ["h", "doc", "pos", "last"])
        got = [sorted(tuple(r.values()) for b in substring_dedup._matches(iter([whole.slice(i, s) for i in range(0, n, s)])) for r in b.to_pylist()) for s in (1, 2, 5, n)]
        assert all(g == got[0] for g in got) and {r[1] for r in got[0] if r[0] == 0} == {d // 2 for d in range(2, n)}


def test_chance_seed_before_a_passage():
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 10**8, 200), rng.integers(0, 10**8, 200)
    b[20:28], b[65:125] = a[20:28], a[65:125]
    seeds = np.array([20, 65, 80, 95, 110])
    assert substring_dedup.align(a, b, seeds, seeds, 50, 0.8) == [(65, 125, 65, 125, 60)]


def test_chains():
    import numpy as np

    x = np.array([0, 10, 20, 30, 40, 500, 510])
    y = np.array([100, 110, 5, 130, 140, 900, 910])
    assert sorted(len(c) for c in substring_dedup.chains(x, y)) == [2, 4]


def test_decontamination(docs, none, items):
    out = decontaminate.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(3, 0), (4, 0), (5, 0), (10, 0)} and all(r["start"] == 20 and r["similarity"] == 1.0 for r in out)
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_of_changed_passages(spark):
    """Every window as similar as asked and within the radius is found: held against all windows of all items."""
    import hashlib
    import random

    rng = random.Random(4)
    word = lambda: rng.choice(WORDS) + rng.choice(WORDS)
    bench = {i: [word() for _ in range(rng.randrange(12, 40))] for i in range(8)}
    texts = {}
    for d in range(60):
        own = list(bench[d % 8])
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = word()
        texts[d] = [word() for _ in range(rng.randrange(30))] + own + [word() for _ in range(rng.randrange(30))]
    grams = lambda w: [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))]

    def sim(g):
        hs = [int(hashlib.md5(x.encode()).hexdigest()[:16], 16) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    best, near = {}, {}
    for d, w in texts.items():
        for i, b in bench.items():
            for s in range(len(w) - len(b) + 1):
                x, y = grams(w[s : s + len(b)]), grams(b)
                j = len(set(x) & set(y)) / len(set(x) | set(y))
                if j >= 0.8:
                    near[d, i] = max(near.get((d, i), 0), j)
                if j >= 0.8 and bin(sim(x) ^ sim(y)).count("1") <= 15:
                    best[d, i] = max(best.get((d, i), 0), j)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in bench.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(docs, items).collect()}
    assert got == pytest.approx(best) and len(best) > 10 and len(best) >= 0.95 * len(near)


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "a b x y c d e f g"), (2, "x y"), (3, "a b c"), (4, "z"), (5, "q z q z q z")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x y"), (2, "z"), (3, "b c")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start"], r["n_words"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1, 2, 2), (2, 1, 0, 2), (3, 3, 1, 2), (4, 2, 0, 1), (5, 2, 1, 1)}


def test_index_filters(spark):
    """Of random pairs under a twentieth share a key, however many items there are."""
    import random

    rng = random.Random(6)
    part = lambda: rng.getrandbits(32)
    masks = decontaminate.neighbour_masks(15)
    keys = lambda name: F.explode(decontaminate.blocks(F.array(f"{name}.a", f"{name}.b"))).alias("key")
    probe = spark.createDataFrame([(i, (part(), part())) for i in range(200)], "w long, s struct<a:long,b:long>").select("w", keys("s"))
    for n in (40, 400):
        index = spark.createDataFrame([(i, (part(), part())) for i in range(n)], "item long, s struct<a:long,b:long>").select("item", keys("s"))
        index = index.select("item", F.explode(F.array(*[F.col("key").bitwiseXOR(F.lit(m).cast("long")) for m in masks])).alias("key"))
        met = probe.join(index, "key").select("w", "item").distinct().count()
        assert met < 0.05 * 200 * n


def test_weighted_jaccard(spark):
    import random
    from collections import Counter

    rng = random.Random(3)
    rows = [([rng.choice("abcdefghij") for _ in range(rng.randrange(9))], [rng.choice("abcdefghij") for _ in range(rng.randrange(9))]) for _ in range(80)]
    out = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", decontaminate.weighted_jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    for a, b, j in out:
        x, y = Counter(a), Counter(b)
        high = sum((x | y).values())
        assert j == pytest.approx(sum((x & y).values()) / high if high else 0.0)


def test_warc(spark, none, tmp_path):
    pages = [(1, "http://a/", "x"), (2, None, None), (3, "http://b/ü \n", ""), (4, "u", "x"), (4, "u", "x"), (5, "u", "é" * 200_000), (None, "n", "x"), (6, "u", "x")]
    df = spark.createDataFrame([(*p, "c", 1) for p in pages], "page_id long, url string, html string, digest string, kind int")
    out = warc.read_warc(spark, f"file:{tmp_path}/w", warc.write_warc(df, f"file:{tmp_path}/w", file_bytes=300)).collect()
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out if r["page_id"] != 4)
    assert got == [(-1, 1, "response", None), (1, 1, "response", None), (2, 0, "response", None), (3, 0, "revisit", 2), (5, 400_000, "response", None), (6, 1, "revisit", 1)]
    assert [(r["record_type"], r["refers_to"]) for r in out if r["page_id"] == 4] == [("revisit", 1)] * 2
    again = warc.read_warc(spark, f"file:{tmp_path}/w")
    assert again.count() == len(pages) and len({r["file"] for r in out}) > 1
    warc.write_warc(df.repartition(5), f"file:{tmp_path}/v", file_bytes=300)
    names = sorted(p.name for p in (tmp_path / "w").glob("part*"))
    assert names and all((tmp_path / "w" / n).read_bytes() == (tmp_path / "v" / n).read_bytes() for n in names)
    (tmp_path / "w" / names[0]).write_bytes(b"")
    with pytest.raises(Exception, match="is not the file"):
        warc.read_warc(spark, f"file:{tmp_path}/w").count()
    assert warc.read_warc(spark, f"file:{tmp_path}/e", warc.write_warc(df.limit(0), f"file:{tmp_path}/e")).count() == 0


def test_urls(spark):
    urls = {None: ("", "", None, "allow"), "no host": ("", "", None, "allow"), "http://WWW.Example.ORG/en/12?x": ("www.example.org", "/en/12", "example.org/en/1", "block"), "http://example.org": ("example.org", "", None, "allow"), "x://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "http://a.com/de/#": ("a.com", "/de/", "com/de/", "block"), "u://a\nb.Example.org/es/1\n?": ("a\nb.example.org", "/es/1\n", "example.org/es/", "block")}
    df = spark.createDataFrame([(i, u, "r", "h", "p", "v") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string, path string, verdict string")
    out = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect()}
    ties = url_filter.judge_urls(df, (("allow", "org", "/"), ("block", "org", "/"))).where("page_id = 2").first()
    assert (ties["rule"], ties["verdict"]) == ("org/", "block")
    assert out == urls and url_filter.judge_urls(df.limit(0)).count() == 0
    assert url_filter.rule_index([("allow", "a.com", "/x/y")], {"h:a": 5, "h:com": 9, "p:x": 1}).keys() == {"p:x"}


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages(spark, docs, none, sf_dir, name):
    stage = dict(P.STAGES)[name]
    assert stage(spark, none, sf_dir).count() == 0
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns + (["shard", "slot"] if name == P.STAGES[-1][0] else [])
    rows = out.collect()
    ids = [r["doc_id"] for r in rows]
    assert {(r["size"], r["rank"], r["h"], r["comp"], r["w"]) for r in rows} == {(1, 2, 3, "c", "w")}
    if name == "n-gram jaccard join":
        assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 6, 7, 8, 9] and ids.count(None) == 1
    if name == "benchmark decontamination":
        assert sorted(ids, key=str) == sorted((r[0] for r in edge_rows()), key=str)


def test_stages_decide_by_row(spark, sf_dir, items):
    """One id on several texts, and rows without an id."""
    held = " ".join(PROSE.split()[20:50])
    rows = [(1, PROSE), (1, LONG), (2, PROSE + " omega"), (3, "quite another text of some words"), (3, "quite another text of some words"), (None, LONG), (None, "no one has an id here at all"), (None, "no one has an id here at all"), (4, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((tuple(r) for r in P.near_duplicates(spark, df, sf_dir).collect()), key=str)
    assert kept == sorted([(1, PROSE), (1, LONG), (3, rows[3][1]), (None, rows[6][1]), (4, None), (4, "")], key=str)
    marked = spark.createDataFrame([(7, "clean words " * 9), (7, f"before {held} after"), (None, held), (8, "clean words " * 9)], "doc_id long, text string")
    table = P.table
    P.table = lambda *a: items.where("item_id = 0")
    try:
        assert sorted(r["doc_id"] for r in P.benchmark(spark, marked, sf_dir).collect()) == [7, 8]
    finally:
        P.table = table


def test_homes_of_large_groups():
    got, held = sharding.homes([(1, 50), (2, 40), (3, 40), (4, 900), (5, 30)], 3, 300)
    assert got == {4: -1, 1: 0, 2: 1, 3: 2, 5: 1} and held == [50, 70, 40]
    assert sharding.homes([], 2, 10) == ({}, [0, 0])


def test_ranges_that_prove_overfull_are_subdivided(spark):
    rows = spark.range(200_000).select(F.xxhash64("id").alias("key"), (F.col("id") % 3).alias("__sub"), F.lit(1).alias("size"))
    dealt = sharding.in_ranges(rows, ["key", "__sub"], "size", range_bytes=2, least=8, total=200_000, coarse=16)
    each = dealt.groupBy("__range").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("__range").collect()
    assert len(each) > 80_000 and max(r["n"] for r in each) < 30  # 100,000 are asked for
    assert all(a["high"] <= b["low"] for a, b in zip(each, each[1:]))
    few = sharding.in_ranges(rows.limit(100), ["key", "__sub"], "size", range_bytes=1 << 20, least=8, total=100)
    assert 4 <= few.select("__range").distinct().count() <= 8


def test_shards_of_subdivided_ranges(spark):
    """The same shards and slots, however the work is cut."""
    rows = spark.range(3000).select("id", (F.col("id") % 37).alias("key"), (F.col("id") % 11 + 1).alias("size")).unionByName(spark.range(3000, 4500).select("id", F.lit(99).cast("long").alias("key"), F.lit(9).cast("long").alias("size")))
    shards = lambda **how: sorted(map(tuple, sharding.shard(rows, shards=5, row_id="id", **how).select("id", "shard", "slot").collect()))
    plain = shards(range_bytes=12_000)
    assert plain == shards(range_bytes=12_000, ranges_per_shard=1) and len(plain) == 4500


def test_components(spark):
    import random

    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(0, 0), (None, 1)]
    up = {i: i for i in range(80)}

    def top(i):
        return i if up[i] == i else top(up[i])

    for a, b in edges[:-1]:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: top(i) for e in edges[:60] for i in e if e[0] != e[1]}


def test_splitters(spark):
    cuts = pick_splitters([(i,) for i in range(100)], [1.0] * 100, 8)
    assert len(cuts) == 7
    got = spark.range(100).select("id", range_of([F.col("id")], cuts).alias("r")).collect()
    assert all(r["r"] == sum(c[0] <= r["id"] for c in cuts) for r in got)


def test_line_variants_against_brute_force(spark):
    """Many variants of few lines, most of them just apart: with enough bands all links are found and no other."""
    import random

    rng = random.Random(12)
    base = [[rng.choice(WORDS) for _ in range(rng.choice((9, 18, 40)))] for _ in range(5)]
    lines = set()
    while len(lines) < 220:
        w = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice(([], [rng.choice(WORDS)], [w[k], rng.choice(WORDS)]))
        lines.add(" ".join(w))
    lines = sorted(lines, key=lambda x: rng.random())
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in lines]
    up = list(range(len(lines)))

    def top(i):
        return i if up[i] == i else top(up[i])

    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(k)))
                up[y] = x
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)] + [(1000 + i, "\n".join([" ".join(base[i % 5])] * 3)) for i in range(5)], "doc_id long, text string")
    got = {r["doc_id"]: r["first_doc"] for r in line_dedup.fuzzy_lines(df, bands=40, rows=2).collect() if r["doc_id"] < 1000}
    want = {i: top(i) for i in range(len(lines))}
    assert got == want and 20 < len(set(got.values())) < 200
    usual = {r["doc_id"]: r["first_doc"] for r in line_dedup.fuzzy_lines(df).collect() if r["doc_id"] < 1000}
    assert sum(usual[i] == want[i] for i in want) >= 0.95 * len(want) and all(top(usual[i]) == want[i] for i in want)
