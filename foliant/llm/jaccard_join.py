"""N-gram Jaccard join by multiple-global-order filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import words as W
from foliant.llm.common import bounded, components, written

REGION = 1 / 3  # the first order counts classes in this part of the token space


def _tokens(size: int, region: float):
    """mapInArrow function: (doc_id, n, class, toks) with the tokens of the first part of the token space (1: all)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("class", pa.int64()), ("toks", pa.list_(pa.int64()))])
    limit = None if region >= 1 else np.uint64(int(region * (1 << 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, classes, toks, held = [], [], [], 0
            done = 0
            ids = batch.column(0)

            def flush(upto: int) -> pa.RecordBatch:
                flat = np.concatenate(toks) if toks else np.zeros(0, np.uint64)
                offs = np.concatenate([[0], np.cumsum([len(t) for t in toks])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(np.int64)))
                return pa.RecordBatch.from_arrays([ids.slice(done, upto - done), pa.array(ns, pa.int32()), pa.array(classes, pa.int64()), lists], schema=schema)

            for i, h in enumerate(W.words(batch.column(1))):
                s = np.unique(W.shingles(h, size))
                ns.append(len(s))
                with np.errstate(over="ignore"):
                    key = W.mix(np.array([W.mix(s, 0x5EED).sum(dtype=np.uint64), len(s)], np.uint64), 0xC1A55)
                    classes.append(int((key[0] * np.uint64(3) + key[1]).view(np.int64)))
                toks.append(s if limit is None else s[: np.searchsorted(s, limit)])
                held += len(toks[-1])
                if held > 1 << 19:
                    yield flush(i + 1)
                    ns, classes, toks, held, done = [], [], [], 0, i + 1
            if done < batch.num_rows:
                yield flush(batch.num_rows)

    return run


SCHEMA = "doc_id long, n int, class long, toks array<long>"


def most(n: Column, percent: int) -> Column:
    """Tokens of a set of n that may be missing from a partner: n - ceil(percent * n / 100)."""
    return (n - F.floor((n * percent + 99) / F.lit(100))).cast("int")


def enough(both: Column, a: Column, b: Column, percent: int) -> Column:
    return F.lit(100) * both >= F.lit(percent) * (a + b - both)


def _live(tokens: DataFrame, percent: int) -> DataFrame:
    """Classes that can have a partner, from (class, n, tok): too many tokens that only one class has rule it out.

    This is prefix filtering under an order that puts unshared tokens first: a prefix of
    n - ceil(t * n) + 1 unshared tokens meets nobody.
    """
    alone = tokens.groupBy("tok").agg(F.min("class").alias("class"), F.max("class").alias("__c")).where("class = __c").groupBy("class").agg(F.count(F.lit(1)).alias("alone"))
    return alone


def jaccard_classes(docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): members (doc_id, n, class) of every row with an id, links (a, b) between classes.

    A class holds the documents with the same shingle set and is named by a 64-bit hash of
    it; links hold at least one path of verified pairs between any two classes that are
    connected. Exact for any data, by these steps:

    1. Order 1: over 1/3 of the token space, count for each token whether more than one
       class has it, and drop the classes whose prefix is unshared.
    2. For those left, count document frequencies of all tokens; three global orders sort a
       set by (frequency, hash_k). A pair must share a prefix token under each of them.
    3. Each class is paired with the anchor of its prefix tokens that has the least part of
       unshared tokens (what copies have in common has none); pairs that pass the size filters and all three
       orders are verified exactly, which joins most of what belongs together.
    4. Then every pair of classes that shares a prefix token under order 1 but lies in
       different components passes the same filters and is verified. Pairs inside a
       component cannot change it, so a large group of near copies never has its pairs
       listed.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    members = rows.mapInArrow(_tokens(size, 0), SCHEMA).select("doc_id", "n", "class")
    members = written(members, "members")
    first = rows.mapInArrow(_tokens(size, REGION), SCHEMA).where("n > 0").select("class", F.explode("toks").alias("tok"))
    sets = members.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    live = sets.join(_live(first, percent), "class", "left").where(F.coalesce("alone", F.lit(0)) <= most(F.col("n"), percent)).select("class", "rep")
    live = written(live, "live")
    reps = bounded(live.select(F.col("rep").alias("doc_id")))
    full = rows.join(reps, "doc_id", "left_semi").mapInArrow(_tokens(size, 1), SCHEMA)
    full = full.join(bounded(live.select(F.col("rep").alias("doc_id"), "class")), ["doc_id", "class"], "left_semi").dropDuplicates(["class"]).select("class", "n", "toks")
    full = written(full, "sets")
    core = written(prefixes(full, percent), "prefixes")
    pairs = written(_anchored(core, percent), "anchored")
    links = written(_verified(_filtered(pairs, core, percent), full, percent), "links")
    tried = bounded(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    rest = across(core, components(links), percent).join(tried, ["a", "b"], "left_anti")
    return members, links.unionByName(written(_verified(rest, full, percent), "links"))


def prefixes(full: DataFrame, percent: int) -> DataFrame:
    """(class, n, s, p1, p2, p3): size, tokens that others have too, and the shared part of the prefix under three orders."""
    toks = full.select("class", "n", F.explode("toks").alias("tok"))
    df = toks.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = toks.join(df, "tok").groupBy("class").agg(F.first("n").alias("n"), F.collect_list(F.struct("df", "tok")).alias("ts"))
    left = most(F.col("n"), percent) + 1 - (F.col("n") - F.size("ts"))
    order = {
        "p1": lambda t: F.struct(t["df"].alias("o"), F.xxhash64(t["tok"]).alias("h"), t["tok"].alias("t")),
        "p2": lambda t: F.struct(F.floor(F.log2(t["df"])).alias("o"), F.xxhash64(F.lit(2), t["tok"]).alias("h"), t["tok"].alias("t")),
        "p3": lambda t: F.struct((t["df"] > 8).cast("int").alias("o"), F.xxhash64(F.lit(3), t["tok"]).alias("h"), t["tok"].alias("t")),
    }
    first = lambda f: F.transform(F.slice(F.array_sort(F.transform("ts", f)), F.lit(1), F.col("left")), lambda x: x["t"])
    return own.withColumn("left", left).where("left > 0").select("class", "n", F.size("ts").alias("s"), *[first(f).alias(p) for p, f in order.items()])


def needed(na: Column, nb: Column, percent: int) -> Column:
    """Common tokens that sets of na and nb need."""
    return F.floor((percent * (na + nb) + (99 + percent)) / F.lit(100 + percent))


def _fits(na: str, sa: str, nb: str, sb: str, percent: int) -> Column:
    """Whether min(sa, sb) common tokens would do for sets of na and nb."""
    return enough(F.least(sa, sb), F.col(na), F.col(nb), percent)


def _filtered(pairs: DataFrame, core: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those of fitting sizes that share a token under every order in the
    first n - needed + 1 tokens of either set."""
    side = lambda x: core.select(F.col("class").alias(x), *[F.col(c).alias(c + x) for c in ("n", "s", "p1", "p2", "p3")])
    room = lambda x: F.greatest(F.lit(0), F.col("s" + x) - F.col("need") + 1).cast("int")
    met = F.lit(True)
    for p in ("p1", "p2", "p3"):
        met = met & F.arrays_overlap(F.slice(p + "a", F.lit(1), room("a")), F.slice(p + "b", F.lit(1), room("b")))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_fits("na", "sa", "nb", "sb", percent))
    return both.withColumn("need", needed(F.col("na"), F.col("nb"), percent)).where(met).select("a", "b")


def _posts(core: DataFrame, labels: DataFrame) -> DataFrame:
    """(tok, class, n, s, comp, r) of the prefixes under order 1 where a token meets more than one
    component; r is the token's place in its set, after those that no other class has."""
    named = core.join(labels.select(F.col("node").alias("class"), "component"), "class", "left")
    posts = named.select("class", "n", "s", F.coalesce("component", "class").alias("comp"), F.posexplode("p1").alias("r", "tok"))
    posts = posts.withColumn("r", F.col("r") + F.col("n") - F.col("s") + 1)
    split = posts.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("tok")
    return written(posts.join(split, "tok"), "posts")


def _anchored(core: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): every class b with the most central class that its prefix tokens under order 1 name."""
    posts = core.select("class", "n", "s", F.explode("p1").alias("tok"))
    centre = F.struct((F.col("s") / F.col("n")).alias("central"), F.col("class").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    anchors = posts.groupBy("tok").agg(F.max(centre).alias("z"))
    named = posts.join(anchors, "tok").select(F.col("class").alias("b"), "n", "s", "z.*").where((F.col("a") != F.col("b")) & _fits("n", "s", "na", "sa", percent))
    return named.groupBy("b").agg(F.max_by("a", F.struct("central", "a")).alias("a")).select("a", "b")


def across(core: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of classes in different components, without listing pairs inside one.

    A class meets the components of a token, with the least size, most shared tokens and least
    place that any of their classes has; only where these would do, it meets the classes.
    """
    posts = _posts(core, labels)
    groups = posts.groupBy("tok", F.col("comp").alias("cb")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("s").alias("most"), F.min("r").alias("least"))
    one = posts.select("tok", F.col("class").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("r").alias("ra"), F.col("comp").alias("ca"))
    near = lambda n, r, need: F.col(r) <= F.col(n) - need + 1
    least = needed(F.col("na"), F.col("lo"), percent)
    may = (F.col("ca") < F.col("cb")) & _fits("na", "sa", "lo", "most", percent) & near("na", "ra", least) & near("hi", "least", least)
    met = one.join(groups, "tok").where(may).drop("lo", "hi", "most", "least")
    two = posts.select("tok", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"), F.col("r").alias("rb"), F.col("comp").alias("cb"))
    need = needed(F.col("na"), F.col("nb"), percent)
    pairs = met.join(two, ["tok", "cb"]).where(_fits("na", "sa", "nb", "sb", percent) & near("na", "ra", need) & near("nb", "rb", need)).select("a", "b").distinct()
    return _filtered(pairs, core, percent)


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    a = full.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    b = full.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    joined = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("ta", "tb")))
    return joined.where(enough(F.col("both"), F.col("na"), F.col("nb"), percent)).select("a", "b")


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs; component_id is the least doc_id reachable by links.

    Two documents link when 100 * |A n B| >= percent * |A u B| over their sets of distinct
    `size`-word shingles (A-Z lower-cased; fewer words: the whole sequence). Documents
    without words or text have n_shingles 0 and are their own component. A null doc_id
    stays in the result with a null component and links with nothing. Repeated rows link
    as any equal texts do. No rows give no rows; other columns are ignored.
    """
    known = docs.where(F.col(doc_id).isNotNull())
    members, links = jaccard_classes(known, size, percent, doc_id, text)
    classes = members.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    labels = components(links)
    linked = classes.join(labels.select(F.col("node").alias("class"), "component"), "class")
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = linked.join(ids, "component").select("class", "component_id")
    # written, so that the join below reads plain shuffles: a class of many copies can then be split
    ids = written(classes.join(moved, "class", "left").select("class", F.coalesce("component_id", "least").alias("component_id")), "ids")
    out = members.where("n > 0").join(bounded(ids), "class").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    empty = members.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    nameless = docs.where(F.col(doc_id).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_tokens(size, 0), SCHEMA)
    nameless = nameless.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(empty).unionByName(nameless)
