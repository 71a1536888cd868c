"""Text expressions of the document flow (C4 to C22, D3 to D26). All are built-in functions.

Regular expressions carry (?U) where Unicode classes are meant, because Java's are ASCII
by default.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SYMBOLS_WIDE = r"[{}\[\]();=<>+\-*/%:,.]"
SYMBOLS_NARROW = r"[{}\[\]();=<>+\-*/%]"
SQL_WORDS = [
    "select", "from", "where", "group", "by", "order", "having", "join", "left", "right", "inner", "outer", "on", "insert", "update", "delete", "create", "table", "with",
    "recursive", "union", "begin", "transaction", "commit", "rollback",
]
CONNECTORS = ["which", "because", "therefore", "works", "calculate", "efficiently", "load", "find"]
MONOSPACE = "courier|mono|consolas|menlo"
PUBLICATION_MARKERS = [
    "volume", "number", "pages", "acm", "communications", "publisher", "press", "verlag", "isbn", "doi",
    "february", "january", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]
CONTINUATIONS = ("else", "elif", "except", "catch", "finally", ".", ")", "]", "}", "&&", "||", "+", "-", "*", "/", "%", "=>", "->", "::")
OPEN_ENDS = ("{", "(", "[", ":", "\\", ",", ".")
STOPWORDS = "the|and|or|to|of|in|is|that|for|with|on|as|by|from"

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


#: What (?U)\s stands for, and any line break: two of them in a row leave a blank line.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
ANY_BREAK = r"[\n-\r\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def only_if(test: Column, then: Column) -> Column:
    """test & then, where then is computed for no row that fails the test: of `&` Spark may compute common parts beforehand."""
    return F.when(test, then).otherwise(F.lit(False))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE))


def has_text(c: Column) -> Column:
    """strip(c) != "", from the left alone: a trim from the right visits every character of the text."""
    return lstrip(c) != ""


def at_most(c: Column, n: int) -> Column:
    """length(strip(c)) <= n, in the same way: nothing but white space stands behind the first n signs."""
    return lstrip(F.substring(lstrip(c), n + 1, (1 << 31) - 1)) == ""


def has_break(c: Column) -> Column:
    """Whether any line break is in it: a search for bytes, where the pattern costs some ten times as much."""
    return reduce(or_, (c.contains(b) for b in BREAKS))


def lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), LINE_BREAK, -1)


def full_lines(c: Column) -> Column:
    """Lines that are not blank, as they stand."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), ANY_BREAK, -1), has_text)


def strip_if_white(c: Column) -> Column:
    """strip(c) of a text that is at hand: most end in no white space, and a trim from the right visits every character to find that."""
    return F.when(F.substring(c, -1, 1).isin(*WHITE), strip(c)).otherwise(lstrip(c))


def line_text(spans: Column) -> Column:
    """C4: span texts joined and stripped."""
    return let(F.array_join(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), ""), strip_if_white)


def block_text(block_lines: Column) -> Column:
    """The non-empty line texts, one per line."""
    return F.array_join(F.filter(F.transform(F.coalesce(block_lines, F.array().cast("array<struct<spans:array<struct<text:string,font:string,size:double>>>>")), lambda x: line_text(x["spans"])), lambda t: t != ""), "\n")


def spans(block_lines: Column) -> Column:
    return F.flatten(F.transform(block_lines, lambda x: x["spans"]))


def font_sizes(block_lines: Column) -> Column:
    """Sizes of all spans; a missing one is skipped."""
    return F.filter(F.transform(spans(block_lines), lambda s: s["size"].cast("double")), lambda x: x.isNotNull())


def fonts(block_lines: Column) -> Column:
    return F.filter(F.transform(spans(block_lines), lambda s: strip(F.coalesce(s["font"], F.lit("")))), lambda x: x != "")


def single_line(c: Column) -> Column:
    """White space collapsed and stripped."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def mend_hyphens(c: Column) -> Column:
    """A word cut at a line end, or before two or more spaces, is joined."""
    at_line_end = F.regexp_replace(c, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    # few texts have a hyphen, and bytes are searched faster than patterns
    return F.when(only_if(c.contains("-"), c.rlike(r"(?U)-\s")), F.regexp_replace(at_line_end, r"(?U)(\w)-\s{2,}(\w)", "$1$2")).otherwise(c)


def density(c: Column, symbols: str) -> Column:
    """Symbols per character."""
    return F.regexp_count(c, F.lit(symbols)) / F.greatest(F.length(c), F.lit(1))


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is not positive."""
    return F.when(denominator > 0, F.try_divide(numerator.cast("double"), denominator.cast("double"))).otherwise(F.lit(0.0))


def _share(items: Column, test) -> Column:
    return let(items, lambda rows: ratio(F.size(F.filter(rows, test)), F.size(rows)))


def _indented_line(x: Column) -> Column:
    return x.startswith("  ") | x.startswith("\t")


def _short_line(x: Column) -> Column:
    return at_most(x, 60)


def indent_ratio(c: Column, strict: bool = True) -> Column:
    """Non-blank lines that start with two spaces or a tab (strict), or with one space or tab."""
    return _share(full_lines(c), _indented_line if strict else lambda x: x.startswith(" ") | x.startswith("\t"))


def short_line_ratio(c: Column, limit: int = 60) -> Column:
    """C14."""
    return _share(full_lines(c), lambda x: at_most(x, limit))


def is_monospace(names: Column) -> Column:
    """C15."""
    return F.exists(names, lambda f: F.lower(f).rlike(MONOSPACE))


def sql_hits(c: Column) -> Column:
    """Tokens of the lower-cased text that are SQL words, repeats counted."""
    return F.size(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[A-Za-z_]+"), F.lit(0)), lambda t: t.isin(SQL_WORDS)))


def line_count(c: Column) -> Column:
    """C17."""
    return F.size(full_lines(c))


def normalized(c: Column) -> Column:
    """Every line right-stripped, the whole stripped."""
    return strip(F.array_join(F.transform(lines(c), rstrip), "\n"))


def for_storage(c: Column) -> Column:
    """C18, storage variant: only line breaks are stripped from the ends."""
    return F.regexp_replace(F.array_join(F.transform(lines(c), rstrip), "\n"), r"^\n+|\n+$", "")


def joined(before: Column, after: Column) -> Column:
    """Two parts of a paragraph; a trailing hyphen is dropped, else one space between."""
    b = strip(after)
    return let(rstrip(before), lambda a: F.when(a == "", b).when(a.endswith("-"), F.concat(F.left(a, F.length(a) - 1), b)).otherwise(F.concat_ws(" ", a, b)))


def _indented(c: Column, closes, opens) -> Column:
    """A fold over stripped lines that keeps the text so far and the level."""
    items = F.transform(full_lines(for_storage(c)), strip)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("level"))

    def step(state: Column, x: Column) -> Column:
        level = F.when(closes(x), F.greatest(F.lit(0), state["level"] - 1)).otherwise(state["level"])
        line = F.concat(F.repeat(F.lit("    "), level), x)
        return F.struct(F.array_append(state["out"], line).alias("out"), (level + F.when(opens(x), 1).otherwise(0)).alias("level"))

    return F.aggregate(items, start, step, lambda s: F.array_join(s["out"], "\n"))


def indent_sql(c: Column) -> Column:
    """C21."""
    return _indented(c, lambda x: F.upper(x).rlike("^(?:COMMIT|ROLLBACK|END)"), lambda x: F.upper(x).rlike("^(?:BEGIN|START TRANSACTION|CASE)"))


def indent_braces(c: Column) -> Column:
    """C22."""
    return _indented(c, lambda x: x.rlike(r"^[}\])]"), lambda x: x.rlike(r"[{\[(]$"))


def numeric_ratio(c: Column) -> Column:
    """Decimal digits of any script per ASCII letter or digit."""
    return F.regexp_count(c, F.lit(r"\p{Nd}")) / F.greatest(F.lit(1), F.regexp_count(c, F.lit("[A-Za-z0-9]")))


def stopword_ratio(c: Column) -> Column:
    """C28."""
    return F.regexp_count(F.lower(c), F.lit(rf"(?U)\b(?:{STOPWORDS})\b")) / F.greatest(F.lit(1), F.regexp_count(c, F.lit(r"(?U)\b\w+\b")))


def punctuation_ratio(c: Column) -> Column:
    """C29."""
    return F.regexp_count(c, F.lit("[.;:!?]")) / F.greatest(F.lit(1), F.length(c))


def to_bool(c: Column, default: bool) -> Column:
    """C30."""
    t = F.lower(strip(c.cast("string")))
    return F.when(t.isin("1", "true", "yes", "y", "on"), True).when(t.isin("0", "false", "no", "n", "off"), False).otherwise(F.lit(default))


def number(c: Column, default: float) -> Column:
    """A double, or the default for null and what is none."""
    return F.coalesce(c.try_cast("double"), F.lit(default))


def integer(c: Column, default: int = 1) -> Column:
    """A whole number of at least 1."""
    return F.greatest(F.lit(1), F.coalesce(c.try_cast("int"), F.lit(default)))


def point(c: Column, default: tuple[float, float] = (0.0, 0.0)) -> Column:
    """The first two of an array of numbers."""
    return F.when(F.size(c) >= 2, F.array(c[0].cast("double"), c[1].cast("double"))).otherwise(F.array(*[F.lit(x) for x in default]))


def unquoted(c: Column) -> Column:
    """One pair of double quotes is taken off; escapes stay."""
    return F.regexp_replace(c, '(?s)^"(.*)"$', "$1")


# ------------------------------------------------------------------ predicates


def head(c: Column) -> Column:
    """What the next tests read of a text; where several are asked, it is cut off once and given to their *_head forms."""
    return F.left(strip(c), F.lit(8))


def number_head(h: Column) -> Column:
    return h.rlike(r"(?U)^\d{1,4}$")


def caption_head(h: Column) -> Column:
    return h.rlike(r"(?i)^(?:figure |fig\. |table )")


def item_head(h: Column) -> Column:
    return h.rlike(r"^(?:- |• |\* |\d\d[.)])")


def is_page_number(c: Column) -> Column:
    """D3: at most four digits."""
    return number_head(head(c))


def is_caption(c: Column) -> Column:
    """D5."""
    return caption_head(head(c))


def is_list_item(c: Column) -> Column:
    """A bullet and a space, or exactly two digits before . or )."""
    return item_head(head(c))


def is_code(c: Column, names: Column) -> Column:
    """D7."""
    points = lambda rows: (
        F.when(is_monospace(names), 3).otherwise(0)
        + F.when(_share(rows, _indented_line) > 0.3, 2).otherwise(0)
        + F.when(_share(rows, _short_line) > 0.6, 2).otherwise(0)
        + F.when(F.size(rows) >= 3, 1).otherwise(0)
    )
    # symbols give 2 points and are counted only where these decide
    score = let(full_lines(c), points)
    text = F.coalesce(c, F.lit(""))
    # one line that is not indented, in no code font, has 2 points at most: no lines are cut for it
    plain = ~F.coalesce(is_monospace(names), F.lit(False)) & ~_indented_line(text) & ~has_break(text)
    return F.when(plain, F.lit(False)).otherwise(let(score, lambda n: F.when(n >= 5, True).when(n < 3, False).otherwise(F.coalesce(density(c, SYMBOLS_WIDE) > 0.05, F.lit(False)))))


def is_late_caption(c: Column) -> Column:
    """No word boundary is asked for."""
    return F.left(lstrip(c), F.lit(8)).rlike(r"(?i)^(?:figure|fig\.|table)\s*\d*")


# The patterns of page artifacts, here and in the tests below.
_PIPE_NUMBER = r"\|\s*\d{1,4}\s*$"
_NUMBER_PIPE_WORD = r"^\d{1,4}\s*\|\s*[A-Za-z]"
_CHAPTER = r"(?i)^chapter\s+\d+\b"


def _starts(t: Column, letters: str) -> Column:
    return F.left(t, F.lit(1)).isin(*letters)


def is_artifact_early(c: Column) -> Column:
    """Page furniture among paragraphs, before merging."""
    tests = lambda t: (F.length(t) <= 100) & (t.rlike(_PIPE_NUMBER) | t.rlike(_NUMBER_PIPE_WORD) | t.rlike(_CHAPTER))
    return let(strip(F.coalesce(c, F.lit(""))), lambda t: F.when(t == "", True).otherwise(only_if(t.contains("|") | _starts(t, "cC"), let(single_line(t), tests))))


def is_artifact_in_code(c: Column) -> Column:
    """Between code blocks."""

    def tests(t: Column) -> Column:
        found = t.rlike(_PIPE_NUMBER) | t.rlike(r"(?i)^\d{1,4}\s*\|\s*chapter\b") | t.rlike(r"(?U)^\d{1,4}\s*\|\s*[A-Za-z][\w\s\-:,]+$") | t.rlike(_CHAPTER)
        return (F.length(t) <= 90) & found

    return let(strip(F.coalesce(c, F.lit(""))), lambda t: F.when(t == "", True).otherwise(only_if(t.contains("|") | _starts(t, "cC"), let(single_line(t), tests))))


def is_artifact_late(c: Column) -> Column:
    """In paragraph merging and in the writer."""
    tests = lambda t: (F.length(t) < 8) | t.rlike(_PIPE_NUMBER) | t.rlike(r"(?i)^\d{1,4}\s*\|\s*chapter\b") | t.rlike(r"(?i)^page\s*\d+$") | t.rlike(r"^\[\d+\]")
    # fewer than eight signs on one line, seen from the first eight of them
    short = lambda t: t.rlike(r"(?U)^(?:\S|\s++){0,7}+$")
    return let(strip(F.coalesce(c, F.lit(""))), lambda t: F.when(t.contains("|") | _starts(t, "pP["), let(single_line(t), tests)).otherwise(short(t)))


def is_citation(c: Column) -> Column:
    """A numbered reference with an identifier, or with two publication words and a year."""

    def referenced(low: Column) -> Column:
        named = low.contains("doi:") | low.rlike(r"\b10\.\d{4,9}/\S+") | low.contains("isbn") | low.rlike(r"\b97[89][-\s\d]{8,20}\b")
        markers = sum((low.contains(m).cast("int") for m in PUBLICATION_MARKERS), F.lit(0))
        return named | ((markers >= 2) & low.rlike(r"\b(?:19|20)\d{2}\b"))

    # the text is stripped, so its first line begins where it does
    return let(normalized(c), lambda n: only_if(n.rlike(r"^\[\d+\]"), let(F.lower(n), referenced)))


def is_running_header(c: Column) -> Column:
    """D18."""

    def tests(n: Column) -> Column:
        stacked = let(F.transform(full_lines(n), strip), lambda rows: (F.size(rows) == 3) & (F.get(rows, F.lit(1)) == "|") & F.get(rows, F.lit(2)).rlike(r"^\d{1,4}$"))
        flat = let(F.regexp_replace(n, r"(?U)\s+", " "), lambda t: t.rlike(_PIPE_NUMBER) | t.rlike(_NUMBER_PIPE_WORD))
        return flat | stacked

    # each of the tests asks for a bar
    return let(normalized(c), lambda n: only_if(n.contains("|"), tests(n)))


def is_confident_code(c: Column) -> Column:
    """D19."""
    low, narrow = F.lower(c), density(c, SYMBOLS_NARROW)
    closed = let(F.transform(full_lines(c), strip), lambda rows: F.get(rows, F.size(rows) - 1).rlike(r"[;}\])]$"))
    transaction = low.contains("begin transaction") & (low.contains("commit") | low.contains("rollback"))
    return transaction | ((sql_hits(c) >= 4) & (narrow >= 0.015)) | ((line_count(c) >= 3) & (narrow >= 0.03) & F.coalesce(closed, F.lit(False)))


def is_explanation(c: Column, fixed: bool = False) -> Column:
    """The first line ends in a colon and has no semicolon.

    The other arm, sentences with connector words, asks for literal backslashes around the
    connector in the original and so never fires; fixed=True looks for the words.
    """
    words = "|".join(CONNECTORS)
    connected = F.lower(c).rlike(rf"\b(?:{words})\b" if fixed else rf"\\b(?:{words})\\b")

    def tests(rows: Column) -> Column:
        head = F.get(rows, F.lit(0))
        first = F.coalesce(head.endswith(":") & ~head.contains(";"), F.lit(False))
        sentences = F.size(F.filter(rows, lambda x: (F.size(F.split(x, r"(?U)\s+")) >= 8) & x.rlike(r"[.:]$")))
        prose = connected & (sentences >= F.greatest(F.lit(1), F.floor(F.size(rows) / 2)))
        return (F.size(rows) > 0) & (first | prose)

    return let(F.transform(full_lines(c), strip), tests)


def is_prose_in_code(c: Column, fixed: bool = False) -> Column:
    """Whether a code block is to become a paragraph."""
    plain = lambda n: is_explanation(n, fixed) & (density(n, SYMBOLS_NARROW) <= 0.02) & (sql_hits(n) <= 2)
    return let(normalized(c), lambda n: (n != "") & (is_running_header(n) | is_citation(n) | (plain(n) & ~is_confident_code(n))))


def is_tiny(c: Column) -> Column:
    """At most one non-blank line of at most 40 characters."""
    return let(full_lines(c), lambda rows: (F.size(rows) == 0) | ((F.size(rows) == 1) & at_most(F.get(rows, F.lit(0)), 40)))


def _quoted(parts: tuple[str, ...]) -> str:
    return "|".join("".join("\\" + ch if not ch.isalnum() else ch for ch in p) for p in parts)


def continues(before: Column, after: Column) -> Column:
    """Whether code on the next page goes on."""
    a, b = rstrip(before), F.lower(lstrip(after))
    open_end = a.rlike(f"(?:{_quoted(OPEN_ENDS)})$") | b.rlike(f"^(?:{_quoted(CONTINUATIONS)})")
    alike = (F.abs(indent_ratio(before, False) - indent_ratio(after, False)) <= 0.25) & (F.abs(density(before, SYMBOLS_WIDE) - density(after, SYMBOLS_WIDE)) <= 0.06)
    return (strip(before) != "") & (strip(after) != "") & (open_end | alike)
