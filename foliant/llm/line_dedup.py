"""Fuzzy line dedup by MinHash."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import bound, bounded, components, discard, written


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, line_no, line) of every line of the whole texts, blank lines too; none for a null text."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def line_key(line: Column) -> Column:
    """64-bit name of a line; equal lines have equal names."""
    return F.xxhash64(line)


def folded(line: Column) -> Column:
    return F.lower(line)


def shingle_set(line: Column, size: int) -> Column:
    """Distinct hashes of all runs of `size` characters, each read in constant time from UTF-32."""
    run = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 4 * size + 1, F.lit(4)), lambda at: F.xxhash64(F.substring(w, at, F.lit(4 * size))))
    return bound(F.encode(folded(line), "UTF-32"), lambda w: F.array_distinct(run(w)))


def band_keys(lines: DataFrame, size: int, bands: int, rows: int, seed: int = 5, step: int = 16) -> DataFrame:
    """(node, occ, keys) from (node, line): MinHash over all character shingles, one key per band.

    The hash functions are one 64-bit hash under XOR with constants: each picks the
    shingle nearest to its constant, which is a minimum under a permutation. A line is cut into
    blocks of `step` shingles whose least values are found in registers, so an aggregate is
    updated once per block. Equal lines are combined on the map side, minima being
    idempotent: no line is shuffled, only signatures are.
    """
    rng = random.Random(seed)
    masks = [rng.getrandbits(63) for _ in range(bands * rows)]
    wide = lines.select("node", F.encode(folded(F.col("line")), "UTF-32").alias("wide")).withColumn("last", F.length("wide") - 4 * size + 1)
    runs = wide.select("node", "wide", "last", F.explode(F.when(F.col("last") > 0, F.sequence(F.lit(1), F.col("last"), F.lit(4 * step)))).alias("at"))
    block = [F.xxhash64(F.substring("wide", F.least(F.col("at") + 4 * k, F.col("last")), F.lit(4 * size))).alias(f"h{k}") for k in range(step)]
    h = runs.select("node", (F.col("at") == 1).cast("int").alias("one"), *block)
    least = lambda m: F.min(F.least(*[F.col(f"h{k}").bitwiseXOR(F.lit(m)) for k in range(step)]))
    sig = h.groupBy("node").agg(F.sum("one").alias("occ"), *[least(m).alias(f"s{k}") for k, m in enumerate(masks)])
    return sig.select("node", "occ", F.array(*[F.xxhash64(F.lit(b), *[f"s{b * rows + r}" for r in range(rows)]) for b in range(bands)]).alias("keys"))


def families(posts: DataFrame) -> DataFrame:
    """(node, anchor, centre): a node's most frequent bucket mate, and the top of the chain of anchors.

    Anchors ascend in (occ, node), so chains end; four steps are followed, which only decides
    who shares a centre. A node without a more frequent mate is its own anchor and centre.
    """
    best = posts.groupBy("key").agg(F.max(F.struct("occ", "node")).alias("z"))
    up = posts.join(bounded(best), "key").groupBy("node").agg(F.max("z").alias("z")).select("node", F.col("z.node").alias("anchor"))
    up = written(up, "anchors")
    centre = up
    for _ in range(2):
        jump = centre.select(F.col("node").alias("__n"), F.col("anchor").alias("__a"))
        centre = centre.join(jump, F.col("anchor") == F.col("__n")).select("node", F.col("__a").alias("anchor"))
    found = written(up.join(centre.select("node", F.col("anchor").alias("centre")), "node"), "families")
    discard(up)
    return found


def needed(na: Column, nb: Column, percent: int) -> Column:
    """Common shingles that sets of na and nb need."""
    return F.ceil(percent * (na + nb) / F.lit(100.0 + percent))


def by_centre(facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one family and different components that may be alike; facts: node, centre, comp, n, o, extra.

    o shingles of a line are also in its centre, `extra` are not. Two lines have at most
    min(o) + |extra common| shingles in common, so they need t = needed - min(o) extra ones
    in common. Where t is not positive, sizes alone decide (first part); else the lines share a
    token among the first |extra| - t + 1 of their extra ones, the rarest first (second part).
    """
    mixed = facts.groupBy("centre").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("centre")
    facts = facts.join(bounded(mixed), "centre").withColumn("m", F.size("extra")).withColumn("band", F.floor(F.log(F.col("n")) / 0.02).cast("int"))
    side = lambda x: facts.select("centre", *[F.col(c).alias(f"{x}{c}") for c in ("node", "comp", "n", "o", "m", "band")])
    need = needed(F.col("an"), F.col("bn"), percent)
    groups = facts.groupBy("centre", "comp", "band").agg(F.min("n").alias("bn"), F.max("o").alias("bo")).select("centre", F.col("comp").alias("bcomp"), F.col("band").alias("bband"), "bn", "bo")
    met = side("a").join(groups, "centre").where((F.col("acomp") != F.col("bcomp")) & (F.least("ao", "bo") >= need)).drop("bn", "bo")
    plain = met.join(side("b"), ["centre", "bcomp", "bband"]).where(F.least("ao", "bo") >= need).select(F.col("anode").alias("a"), F.col("bnode").alias("b"))

    toks = facts.select("centre", "comp", "node", F.explode("extra").alias("e"))
    df = toks.groupBy("centre", "e").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("df"))
    toks = toks.join(df.where("x <> y").select("centre", "e", "df"), ["centre", "e"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("ts"))
    posts = toks.join(facts.drop("extra"), "node").select("centre", "node", "comp", "n", "o", "m", F.size("ts").alias("k"), F.posexplode("ts").alias("r", "t"))
    posts = written(posts.select("centre", F.col("t.e").alias("e"), "node", "comp", "n", "o", "m", (F.col("m") - F.col("k") + F.col("r") + 1).alias("r")), "extra")
    groups = posts.groupBy("centre", "e", "comp").agg(F.min("n").alias("bn"), F.max("o").alias("bo"), F.max("m").alias("bm"), F.min("r").alias("br")).withColumnRenamed("comp", "bcomp")
    one = posts.select("centre", "e", *[F.col(c).alias(f"a{c}") for c in ("node", "comp", "n", "o", "m", "r")])
    two = posts.select("centre", "e", *[F.col(c).alias(f"b{c}") for c in ("node", "comp", "n", "o", "m", "r")])
    t = F.greatest(F.lit(1), need - F.least("ao", "bo"))
    may = (F.col("ar") <= F.col("am") - t + 1) & (F.col("br") <= F.col("bm") - t + 1)
    met = one.join(groups, ["centre", "e"]).where((F.col("acomp") < F.col("bcomp")) & may).drop("bn", "bo", "bm", "br")
    rare = met.join(two, ["centre", "e", "bcomp"]).where(may).select(F.col("anode").alias("a"), F.col("bnode").alias("b"))
    return plain.unionByName(rare).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def between_centres(posts: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components and different centres that share a band."""
    named = written(posts.select("key", "node").join(facts.select("node", "centre", "comp"), "node"), "named")
    split = named.groupBy("key").agg(F.min("centre").alias("x"), F.max("centre").alias("y"), F.min("comp").alias("u"), F.max("comp").alias("v")).where("x <> y and u <> v").select("key")
    named = named.join(bounded(split), "key")
    groups = named.select("key", F.col("centre").alias("cb"), F.col("comp").alias("pb")).distinct()
    met = named.join(groups, "key").where((F.col("centre") < F.col("cb")) & (F.col("comp") != F.col("pb"))).select("key", F.col("node").alias("a"), "cb", "pb")
    return met.join(named.select("key", F.col("centre").alias("cb"), F.col("comp").alias("pb"), F.col("node").alias("b")), ["key", "cb", "pb"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def has_text(line: Column) -> Column:
    """Whether anything but white space is in the line; most lines show it with their first character."""
    return ~F.substring(line, 1, 1).isin("", " ", "\t", "\n", "\x0b", "\f", "\r") | line.rlike(r"\S")


def fuzzy_lines(docs: DataFrame, size: int = 8, percent: int = 80, bands: int = 10, rows: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, keep, first_doc, first_line) for every line of docs.

    Lines are alike if the Jaccard similarity of their lower-cased `size`-character shingle
    sets is at least `percent` / 100; of each component of alike lines the first by
    (doc_id, line_no) is kept, and first_doc and first_line name it. Equal lines are always
    alike, shorter lines only if equal; blank lines (nothing but white space) are all kept.

    Equal lines are one node. Candidates agree on all `rows` values of one of `bands`
    bands: a pair at 0.8 is met with probability 1 - (1 - 0.8^4)^10 = 0.995. Nodes are
    first verified against the most frequent line of their buckets (what is most often copied
    is what variants come from); after distributed union-find the pairs between components
    are narrowed by what the lines have beyond that centre, which loses no link, and verified
    too. Every link is verified exactly on the whole lines; pairs inside a component are never
    listed.

    A null text has no lines, an empty text one blank line. A null doc_id orders first.
    Repeated rows repeat their lines, and of fully equal (doc_id, line_no, line) all or
    none are kept. No rows give no rows; other columns are ignored.
    """
    every = lines_of(docs, doc_id, text).withColumn("node", F.when(has_text(F.col("line")), line_key(F.col("line"))))
    places = written(every.select("doc_id", "line_no", "node"), "places")
    real = every.where("node is not null").select("node", "line")
    banded = written(band_keys(real, size, bands, rows), "bands")
    keys = banded.select("node", "occ", F.explode("keys").alias("key"))
    common = written(keys.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key"), "keys")
    posts = written(keys.join(bounded(common), "key"), "shared")
    discard(banded, common)
    wanted = bounded(posts.select("node").distinct())
    texts = written(real.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "candidates")

    def compared(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("node").alias("a"), F.col("line").alias("la"))
        b = texts.select(F.col("node").alias("b"), F.col("line").alias("lb"))
        sets = pairs.join(a, "a").join(b, "b").select("a", "b", shingle_set(F.col("la"), size).alias("sa"), shingle_set(F.col("lb"), size).alias("sb"))
        return sets.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.array_except("sb", "sa").alias("extra")).withColumn("o", F.col("nb") - F.size("extra"))

    alike = (F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * percent) & (F.col("a") != F.col("b"))
    family = families(posts)
    to_centre = written(compared(family.select(F.col("centre").alias("a"), F.col("node").alias("b"))), "centres")
    links = to_centre.where(alike).select("a", "b").unionByName(written(compared(family.where("anchor <> centre").select(F.col("anchor").alias("a"), F.col("node").alias("b"))).where(alike).select("a", "b"), "links"))
    labels = components(links).select("node", "component")
    discard(family)
    facts = to_centre.select(F.col("b").alias("node"), F.col("a").alias("centre"), F.col("nb").alias("n"), "o", "extra").join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    facts = written(facts, "facts")
    discard(labels)
    rest = by_centre(facts, percent).unionByName(between_centres(posts, facts))
    links = links.unionByName(written(compared(rest.distinct()).where(alike).select("a", "b"), "links"))
    discard(posts, texts, rest)
    known = places.where("node is not null")
    linked = components(links)
    discard(links)
    often = known.groupBy("node").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("node")
    told = often.join(linked, "node", "full").select("node", F.coalesce("component", "node").alias("component"))
    told = written(told, "told")  # all other lines stand alone
    discard(linked)
    place = F.struct(F.col("doc_id").alias("first_doc"), F.col("line_no").alias("first_line"))
    best = known.join(bounded(told), "node").groupBy("component").agg(F.min(place).alias("best"))
    best = written(told.join(best, "component").select("node", "best"), "best")
    discard(told)
    out = known.join(bounded(best), "node", "left")
    same = F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.first_doc")) & (F.col("line_no") == F.col("best.first_line")))
    first = lambda own, name: F.when(F.col("best").isNull(), F.col(own)).otherwise(F.col(f"best.{name}")).alias(name)
    out = out.select("doc_id", "line_no", same.alias("keep"), first("doc_id", "first_doc"), first("line_no", "first_line"))
    blank = places.where("node is null").select("doc_id", "line_no", F.lit(True).alias("keep"), F.col("doc_id").alias("first_doc"), F.col("line_no").alias("first_line"))
    return out.unionByName(blank)


def without_repeats(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the lines that `found` does not keep cut out of their texts; rows with a null doc_id are unchanged."""
    gone = found.where("not keep and doc_id is not null").groupBy(F.col("doc_id").alias("__d")).agg(F.collect_set("line_no").alias("__gone"))
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("__gone", i))
    joined = docs.join(gone, docs[doc_id] == F.col("__d"), "left")
    return joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__d", "__gone")
