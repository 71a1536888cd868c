"""URL filters: rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) in the order in which they were written.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_tokens(host: str, path: str) -> list[str]:
    """The tokens that every URL of the rule has: host labels, and path segments closed by a slash."""
    return [f"h:{x}" for x in host.split(".") if x] + [f"p:{x}" for x in path.split("/")[1:-1] if x]


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, named as rule_tokens names them."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def token_counts(tokens: DataFrame, column: str, wanted: Sequence[str]) -> dict[str, int]:
    """In how many of all rows each token of the rules occurs; as many entries as tokens."""
    found = tokens.select(F.explode(column).alias("t")).where(F.col("t").isin(list(wanted))).groupBy("t").count()
    return {r["t"]: r["count"] for r in found.collect()} if wanted else {}


def rule_index(rules: Sequence[tuple[str, str, str]], counts: dict[str, int]) -> dict[str, list[tuple[str, str, str]]]:
    """token -> [(rule text, verdict, pattern)], each rule under its rarest token ('' if it has none)."""
    index: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in rules:
        tokens = rule_tokens(host, path)
        token = min(tokens, key=lambda t: (counts.get(t, 0), t)) if tokens else ""
        # a ? is in no host and in no path, so it parts them
        pattern = rf"(?:[^?]*\.)?{re.escape(host)}\?{re.escape(path)}" if host else rf"[^?]*\?{re.escape(path)}"
        index.setdefault(token, []).append((host + path, verdict, pattern))
    return index


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """pages plus host, path, rule and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path; the
    longest fitting rule wins (its text host + path; ties: block before allow). Each rule
    is kept under the token that the fewest URLs of the whole table have; a URL's tokens
    fetch candidates, and only these run their regular expression. The rules are a
    parameter, sent with the task; the pages are not shuffled.

    A null url, or one without ://, has an empty host and path, so no rule fits: rule is
    null and the verdict is `default`. Repeated rows are judged alike; no rows give no
    rows; columns of pages with the four new names are replaced.
    """
    base = pages.drop("host", "path", "rule", "verdict").withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    tokens = base.withColumn("__tokens", url_tokens(F.col("host"), F.col("path")))
    wanted = sorted({t for _, h, p in rules for t in rule_tokens(h, p)})
    index = rule_index(rules, token_counts(tokens, "__tokens", wanted))

    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ready = {t: [(r, v, re.compile(p)) for r, v, p in own] for t, own in index.items()}
        always = ready.get("", [])
        for hosts, paths, toks in batches:
            rule, verdict = [], []
            for h, p, ts in zip(hosts, paths, toks):
                fits = [(len(r), v == "block", r, v) for c in [always, *(ready[t] for t in ts if t and t in ready)] for r, v, rx in c if rx.match(f"{h}?{p}")]
                best = max(fits, default=(0, False, None, default))
                rule.append(best[2])
                verdict.append(best[3])
            yield pd.DataFrame({"rule": rule, "verdict": verdict})

    judged = F.pandas_udf(judge, "rule string, verdict string")
    out = tokens.withColumn("__j", judged("host", "path", "__tokens"))
    return out.select(*base.columns, "__j.rule", "__j.verdict")
