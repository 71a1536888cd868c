"""DuckDB SQL for the queries, put together from common table expressions."""

from __future__ import annotations

NL = "chr(10)"

# Fixed values, written out here so that a slip in the engine's own shows.
WIDE, NARROW = r"[{}\[\]();=<>+\-*/%:,.]", r"[{}\[\]();=<>+\-*/%]"
SQL_WORDS = [
    "select", "from", "where", "group", "by", "order", "having", "join", "left", "right", "inner", "outer", "on", "insert", "update", "delete", "create", "table", "with",
    "recursive", "union", "begin", "transaction", "commit", "rollback",
]
MARKERS = [
    "volume", "number", "pages", "acm", "communications", "publisher", "press", "verlag", "isbn", "doi",
    "february", "january", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]
STOPWORDS = ["the", "and", "or", "to", "of", "in", "is", "that", "for", "with", "on", "as", "by", "from"]
DIGITS = r"\p{Nd}"


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def rstrip(t: str) -> str:
    return rf"regexp_replace({t}, '\s+$', '')"


def full(t: str) -> str:
    return f"list_filter(string_split({t}, {NL}), lambda x_: {strip('x_')} <> '')"


def trimmed_lines(t: str) -> str:
    return f"list_transform({full(t)}, lambda y_: {strip('y_')})"


def hits(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def density(t: str, pattern: str) -> str:
    return f"({hits(t, pattern)}::DOUBLE / greatest(length({t}), 1))"


def share(t: str, test: str) -> str:
    return f"(CASE WHEN len({full(t)}) > 0 THEN len(list_filter({full(t)}, lambda z_: {test}))::DOUBLE / len({full(t)}) ELSE 0.0::DOUBLE END)"


def indent(t: str) -> str:
    return share(t, r"regexp_matches(z_, '^(?:  |\t)')")


def short(t: str) -> str:
    return share(t, f"length({strip('z_')}) <= 60")


def single(t: str) -> str:
    return strip(rf"regexp_replace({t}, '\s+', ' ', 'g')")


def normalized(t: str) -> str:
    return strip(f"array_to_string(list_transform(string_split({t}, {NL}), lambda n_: {rstrip('n_')}), {NL})")


def sql_hits(t: str) -> str:
    words = ", ".join(f"'{w}'" for w in SQL_WORDS)
    return f"len(list_filter(regexp_extract_all(lower({t}), '[A-Za-z_]+'), lambda w_: list_contains([{words}], w_)))"


def artifact_early(t: str) -> str:
    s = single(t)
    return rf"({s} = '' OR (length({s}) <= 100 AND (regexp_matches({s}, '\|\s*\d{{1,4}}\s*$') OR regexp_matches({s}, '^\d{{1,4}}\s*\|\s*[A-Za-z]') OR regexp_matches({s}, '(?i)^chapter\s+\d+\b'))))"


def artifact_late(t: str) -> str:
    s = single(t)
    return rf"(length({s}) < 8 OR regexp_matches({s}, '\|\s*\d{{1,4}}\s*$') OR regexp_matches({s}, '(?i)^\d{{1,4}}\s*\|\s*chapter\b') OR regexp_matches({s}, '(?i)^page\s*\d+$') OR regexp_matches({s}, '^\[\d+\]'))"


def tiny(t: str) -> str:
    rows = trimmed_lines(t)
    return f"(len({rows}) = 0 OR (len({rows}) = 1 AND length({rows}[1]) <= 40))"


def mended(t: str) -> str:
    w = r"[\p{L}\p{M}\p{N}_]"
    return rf"regexp_replace(regexp_replace({t}, '({w})-\s*\n\s*({w})', '\1\2', 'g'), '({w})-\s{{2,}}({w})', '\1\2', 'g')"


def demoted(t: str) -> str:
    n = normalized(t)
    rows = trimmed_lines("n_text")
    flat = r"regexp_replace(n_text, '\s+', ' ', 'g')"
    header = rf"(regexp_matches({flat}, '\|\s*\d{{1,4}}\s*$') OR (len({rows}) = 3 AND {rows}[2] = '|' AND regexp_matches({rows}[3], '^\d{{1,4}}$')) OR regexp_matches({flat}, '^\d{{1,4}}\s*\|\s*[A-Za-z]'))"
    markers = " + ".join(f"(CASE WHEN contains(lower(n_text), '{m}') THEN 1 ELSE 0 END)" for m in MARKERS)
    named = r"(contains(lower(n_text), 'doi:') OR regexp_matches(lower(n_text), '\b10\.\d{4,9}/\S+') OR contains(lower(n_text), 'isbn') OR regexp_matches(lower(n_text), '\b97[89][-\s\d]{8,20}\b'))"
    citation = rf"(regexp_matches(lower({strip(f'string_split(n_text, {NL})[1]')}), '^\[\d+\]') AND ({named} OR ({markers} >= 2 AND regexp_matches(lower(n_text), '\b(?:19|20)\d{{2}}\b'))))"
    confident = rf"((contains(lower(n_text), 'begin transaction') AND (contains(lower(n_text), 'commit') OR contains(lower(n_text), 'rollback'))) OR ({sql_hits('n_text')} >= 4 AND {density('n_text', NARROW)} >= 0.015) OR (len({rows}) >= 3 AND {density('n_text', NARROW)} >= 0.03 AND regexp_matches({rows}[-1], '[;}}\])]$')))"
    explained = f"(len({rows}) > 0 AND ends_with({rows}[1], ':') AND NOT contains({rows}[1], ';') AND {density('n_text', NARROW)} <= 0.02 AND {sql_hits('n_text')} <= 2)"
    return f"(SELECT n_text <> '' AND ({header} OR {citation} OR (NOT {confident} AND {explained})) FROM (SELECT {n} AS n_text))"


# ------------------------------------------------------------------ the canonical adapter

LINES = f"""
ml AS (SELECT doc_id, i, line, ((doc_id * 7 + i) % 12)::INT AS k FROM (
    SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), {NL}))))::INT AS i, unnest(string_split(coalesce(text, ''), {NL})) AS line FROM documents)),
"""

BLOCKS = (
    LINES
    + rf"""
mp AS (SELECT doc_id, i, line, part, CASE WHEN part = 1 THEN 10 ELSE k END AS k FROM ml, (VALUES (0), (1)) p(part) WHERE part = 0 OR k BETWEEN 4 AND 9),
bk AS (SELECT doc_id, i, k, (i // 8 + 1)::INT AS page_number, (i % 8 * 2 + part)::INT AS block_no,
    CASE WHEN k = 11 AND i % 5 = 0 THEN 1 WHEN k = 11 AND i % 5 = 1 THEN 2 ELSE 0 END AS block_type,
    CASE k WHEN 1 THEN 'Figure ' || i || ' ' || line WHEN 2 THEN '10. ' || line WHEN 3 THEN '- ' || line
        WHEN 4 THEN CASE WHEN i % 2 = 0 THEN 'call_' || i || '(a, b);' || {NL} || 'return x[' || k || '];' ELSE 'call(' || i || ', {{' || {NL} || 'y = 1' END
        WHEN 5 THEN CASE i % 3 WHEN 0 THEN 'The following query returns:' WHEN 1 THEN 'SELECT a, b FROM t_' || i || ' WHERE a = 1 AND b = 2 ORDER BY a;' ELSE 'else {{' || {NL} || '  z = ' || i || ';' || {NL} || '}}' END
        WHEN 6 THEN i::VARCHAR WHEN 7 THEN left(line, 20) || ' | ' || i WHEN 8 THEN '[' || i || '] ' || left(line, 24) || ' ISBN 978 Press 2017'
        WHEN 9 THEN left(line, 60) || 'a-' || {NL} || 'b' || CASE WHEN i % 2 = 0 THEN ' end-' ELSE ' end' END ELSE line END AS body,
    k IN (4, 5, 8) AS mono, CASE WHEN k = 0 THEN 16.0 ELSE 10.0 END::DOUBLE AS size,
    CASE WHEN doc_id % 5 = 0 AND i % 2 = 1 THEN 350.0 ELSE 60.0 END::DOUBLE AS x0, (40.0 + 90.0 * (i % 8) + 45.0 * part)::DOUBLE AS y0 FROM mp),
bs AS (SELECT doc_id, page_number, median(size) AS body_size FROM (SELECT doc_id, page_number, size, unnest(range(len(string_split(body, {NL})))) FROM bk WHERE block_type = 0) GROUP BY ALL),
bt AS (SELECT bk.*, coalesce(body_size, 10.0) AS body_size, CASE WHEN block_type = 0 THEN size ELSE coalesce(body_size, 10.0) END AS max_size,
    x0 + 200.0 AS x1, y0 + 80.0 AS y1, x0 / 612.0 AS nx0, y0 / 792.0 AS ny0, (x0 + 200.0) / 612.0 AS nx1, (y0 + 80.0) / 792.0 AS ny1,
    CASE WHEN block_type = 0 THEN array_to_string({trimmed_lines("body")}, {NL}) END AS text FROM bk LEFT JOIN bs USING (doc_id, page_number)),
bl AS (SELECT *, block_type = 0 AND {strip("text")} <> '' AS shown,
    (CASE WHEN mono THEN 3 ELSE 0 END) + (CASE WHEN {indent("text")} > 0.3 THEN 2 ELSE 0 END) + (CASE WHEN {short("text")} > 0.6 THEN 2 ELSE 0 END) + (CASE WHEN {density("text", WIDE)} > 0.05 THEN 2 ELSE 0 END) + (CASE WHEN len({full("text")}) >= 3 THEN 1 ELSE 0 END) AS code FROM bt),
bc AS (SELECT *, CASE WHEN block_type = 1 THEN 'image' WHEN shown THEN CASE
        WHEN regexp_matches(lower({strip("text")}), '^(?:figure |fig\. |table )') THEN 'caption' WHEN regexp_matches({strip("text")}, '^(?:- |• |\* |\d\d[.)])') THEN 'list_item'
        WHEN code >= 5 THEN 'code_block' WHEN max_size >= body_size * 1.25 THEN 'heading' ELSE 'paragraph' END END AS elem_type,
    coalesce(shown, false) AND regexp_matches({strip("coalesce(text, '')")}, '^\d{{1,4}}$') AS is_number,
    CASE WHEN shown THEN CASE WHEN ny0 <= 0.08 THEN 'header' WHEN ny1 >= 0.92 THEN 'footer' END END AS region FROM bl),
"""
)

ORDERED = (
    BLOCKS
    + f"""
pg AS (SELECT doc_id, page_number, count(*) AS n FROM bk GROUP BY ALL),
dw AS (SELECT doc_id, page_number, n, ((doc_id + page_number) % 5)::INT AS item_count, CASE WHEN (doc_id + page_number) % 3 = 0 THEN 20.0 ELSE 200.0 END::DOUBLE AS side FROM pg),
bi AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY block_no) - 1 AS idx FROM bc),
el AS (SELECT doc_id, page_number, idx, unnest(list_filter([elem_type, CASE WHEN region IS NOT NULL THEN 'header_footer' END, CASE WHEN is_number THEN 'page_number' END], lambda e: e IS NOT NULL)) AS elem_type,
        text, nx0, ny0, nx1 - nx0 AS nw, ny1 - ny0 AS nh, NULL::INT AS item_count, CASE WHEN elem_type = 'image' THEN i END AS image_xref, CASE WHEN elem_type = 'image' AND i % 2 = 0 THEN 'png' END AS image_ext FROM bi
    UNION ALL SELECT doc_id, page_number, n, 'drawing', NULL, 60.0 / 612.0, 100.0 / 792.0, side / 612.0, side / 792.0, item_count, NULL, NULL FROM dw),
ty AS (SELECT * EXCLUDE (text), CASE WHEN elem_type = 'heading' THEN {single("text")} ELSE text END AS text, idx + (greatest(1, page_number) - 1)::BIGINT * 100000 AS gidx,
    (list_position(['heading', 'paragraph', 'list_item', 'caption', 'code_block', 'image', 'table', 'drawing', 'link', 'annotation', 'header_footer', 'page_number'], elem_type) - 1)::INT AS type_ordinal,
    CASE WHEN elem_type = 'image' THEN row_number() OVER (PARTITION BY doc_id, elem_type ORDER BY page_number, idx) END::INT AS image_index FROM el),
od AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gidx, page_number, type_ordinal) AS pos FROM ty),
"""
)

SECTIONS = (
    ORDERED
    + """
se AS (SELECT * FROM (SELECT *, (sum(CASE WHEN elem_type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos))::INT AS section_number FROM od) WHERE section_number > 0),
"""
)

CLEAN = (
    SECTIONS
    + rf"""
pk AS (SELECT * FROM se WHERE NOT (elem_type IN ('link', 'header_footer', 'page_number') OR (elem_type = 'paragraph' AND {artifact_early("text")}) OR (elem_type = 'drawing' AND (nw * nh <= 0.002 OR item_count <= 2)))),
ph AS (SELECT * EXCLUDE (text), CASE WHEN elem_type IN ('heading', 'paragraph', 'list_item', 'caption') THEN {mended("text")} ELSE text END AS text FROM pk),
cl AS (SELECT * EXCLUDE (elem_type), CASE WHEN elem_type = 'paragraph' AND regexp_matches({strip("text")}, '(?i)^(?:figure|fig\.|table)\s*\d*') THEN 'caption' ELSE elem_type END AS elem_type FROM ph),
"""
)

DEMOTED = (
    CLEAN
    + f"""
dm AS (SELECT * EXCLUDE (text, elem_type), CASE WHEN gone THEN {normalized("text")} ELSE text END AS text, CASE WHEN gone THEN 'paragraph' ELSE elem_type END AS elem_type
    FROM (SELECT *, elem_type = 'code_block' AND {demoted("text")} AS gone FROM cl)),
"""
)


def q(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip().rstrip(',')}\n{select}"


JOINED = rf"""CASE WHEN {rstrip("a")} = '' THEN {strip("b")} WHEN ends_with({rstrip("a")}, '-') THEN left({rstrip("a")}, length({rstrip("a")}) - 1) || {strip("b")} ELSE {rstrip("a")} || ' ' || {strip("b")} END"""

def merged_paragraphs(source: str) -> str:
    return rf"""
pm AS (SELECT *, elem_type = 'paragraph' AS p, elem_type IN ('link', 'annotation', 'page_number') AS b, sum(CASE WHEN elem_type IN ('paragraph', 'link', 'annotation', 'page_number') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, section_number ORDER BY pos) AS seg FROM {source}),
pf AS (SELECT *, min(CASE WHEN p THEN pos END) OVER (PARTITION BY doc_id, section_number, seg) AS first FROM pm),
pj AS (SELECT doc_id, section_number, first AS pos, list(text ORDER BY pos) AS parts FROM pf WHERE p AND pos > first AND NOT {artifact_late("text")} AND NOT {tiny("text")} GROUP BY doc_id, section_number, first),
pz AS (SELECT * EXCLUDE (text, parts, p, b, seg, first), CASE WHEN parts IS NULL THEN text ELSE list_reduce(list_concat([{rstrip("text")}], parts), lambda a, b: {JOINED}) END AS text FROM pf LEFT JOIN pj USING (doc_id, section_number, pos) WHERE NOT (p OR b) OR first IS NULL OR pos <= first),
"""


def reflowed(source: str) -> str:
    return f"""
rx AS (SELECT *, CASE WHEN elem_type IN ('heading', 'paragraph', 'list_item', 'caption', 'code_block') THEN nx0 END AS x FROM {source}),
rm AS (SELECT *, coalesce(count(x) OVER w >= 6 AND max(x) OVER w - min(x) OVER w >= 0.25 AND count(CASE WHEN x <= 0.45 THEN 1 END) OVER w >= 2 AND count(CASE WHEN x >= 0.55 THEN 1 END) OVER w >= 2, false) AS m FROM rx WINDOW w AS (PARTITION BY doc_id, section_number, page_number)),
rr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_number, page_number ORDER BY CASE WHEN m THEN round_even(ny0 / 0.03, 0) ELSE 0 END, CASE WHEN m THEN nx0 ELSE 0 END, gidx, pos) AS rk, min(gidx) OVER (PARTITION BY doc_id, section_number, page_number) AS lo FROM rm),
rz AS (SELECT * EXCLUDE (pos, x, m, rk, lo), row_number() OVER (PARTITION BY doc_id, section_number ORDER BY page_number, rk) AS pos, CASE WHEN m THEN lo + rk - 1 ELSE gidx END AS reading_order_index FROM rr),
"""


def lined(source: str) -> str:
    return f"""
rs AS (SELECT *, CASE elem_type WHEN 'code_block' THEN 'code_blocks' WHEN 'image' THEN 'images' WHEN 'drawing' THEN 'drawings' END AS kind, lag(page_number) OVER (PARTITION BY doc_id, section_number ORDER BY pos) AS before FROM {source}),
rn AS (SELECT *, 'resources/' || kind || '/' || section_number || '_' || page_number || '_' || kind || '_' || row_number() OVER (PARTITION BY doc_id, section_number, page_number, kind ORDER BY pos) || '.txt' AS path FROM rs),
ln AS (SELECT doc_id, section_number, pos, CASE WHEN before IS NULL THEN 'page_number: ' || page_number || {NL} || {NL} WHEN before <> page_number THEN {NL} || 'page_number: ' || page_number || {NL} || {NL} ELSE '' END AS head,
    CASE elem_type WHEN 'heading' THEN 'HEADING ' || text WHEN 'list_item' THEN 'LIST_ITEM ' || text WHEN 'caption' THEN 'CAPTION ' || text WHEN 'paragraph' THEN CASE WHEN NOT {artifact_late("text")} THEN 'PARAGRAPH ' || text END
        WHEN 'code_block' THEN 'CODE_BLOCK ' || path WHEN 'image' THEN 'IMAGE ' || path WHEN 'drawing' THEN 'DRAWING ' || path END || {NL} AS line FROM rn),
"""


WHOLE = f"('section_number: ' || section_number || {NL} || {NL} || string_agg(head || coalesce(line, ''), '' ORDER BY pos))"
CONTENT = f"SELECT doc_id, section_number, {strip(WHOLE)} || {NL} AS content FROM ln GROUP BY doc_id, section_number"

ORACLE: dict[str, str] = {
    "section_outline": q(CLEAN, "SELECT doc_id, section_number, arg_min(page_number, pos) AS first_page, arg_min(text, pos) FILTER (elem_type = 'heading') AS heading, count(*) AS n_elements, count(*) FILTER (elem_type = 'paragraph') AS n_paragraphs, coalesce(sum(length(text)), 0)::BIGINT AS n_chars FROM cl GROUP BY doc_id, section_number"),
    "section_listing": q(SECTIONS, f"SELECT doc_id, section_number, arg_min(page_number, pos) AS page_number, {single('arg_min(text, pos)')} AS heading FROM se WHERE elem_type = 'heading' GROUP BY doc_id, section_number"),
    "block_classify": q(BLOCKS, "SELECT doc_id, page_number, block_no, elem_type, is_number, region, body_size, max_size, text FROM bc"),
    "reading_order": q(ORDERED, "SELECT doc_id, page_number, gidx AS reading_order_index, type_ordinal, elem_type, pos, image_index, image_xref, image_ext FROM od"),
    "normalize_geometry": q(BLOCKS, "SELECT doc_id, page_number, block_no, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x1 - x0, 6) AS width, round(y1 - y0, 6) AS height, round(nx0, 6) AS n_x0, round(ny0, 6) AS n_y0, round(nx1, 6) AS n_x1, round(ny1, 6) AS n_y1, round(nx1 - nx0, 6) AS n_width, round(ny1 - ny0, 6) AS n_height FROM bt"),
    "html_elements": rf"""
WITH f AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?i)<(?:h1|p|li|a|nav|footer)(?:\s[^<>]*)?>[^<]*') AS m FROM pages),
e AS (SELECT page_id, unnest(range(len(m)))::INT AS position, unnest(m) AS m FROM f)
SELECT page_id, position, CASE lower(regexp_extract(m, '^<([A-Za-z0-9]+)', 1)) WHEN 'h1' THEN 'heading' WHEN 'p' THEN 'paragraph' WHEN 'li' THEN 'list_item' WHEN 'a' THEN 'link' ELSE 'header_footer' END AS elem_type,
    {single(r"regexp_extract(m, '^<[^>]*>((?s:.*))$', 1)")} AS text, CASE WHEN lower(regexp_extract(m, '^<([A-Za-z0-9]+)', 1)) = 'a' AND regexp_extract(m, '(?i)href="([^"]*)"', 1) <> '' THEN regexp_extract(m, '(?i)href="([^"]*)"', 1) END AS uri FROM e""",
    "page_ranges": q(LINES, "SELECT doc_id, s::INT AS start_page, least(s + 2, total)::INT AS end_page FROM (SELECT doc_id, total, unnest(range(1, total + 1, 3)) AS s FROM (SELECT doc_id, max(i) // 8 + 1 AS total FROM ml GROUP BY doc_id))"),
    "page_export": q(ORDERED, "SELECT doc_id, page_number AS page, " + ", ".join(f"(count(*) FILTER (elem_type = '{t}'))::INT AS n_{t}" for t in "heading paragraph list_item caption code_block image table drawing link annotation header_footer page_number".split()) + ", coalesce(string_agg(text, '|' ORDER BY gidx) FILTER (elem_type = 'heading'), '') AS headings FROM od GROUP BY doc_id, page_number"),
    "preclean": q(CLEAN, "SELECT doc_id, section_number, pos, elem_type, text FROM cl"),
    "section_range_select": q(SECTIONS + "ss AS (SELECT *, section_number BETWEEN 2 AND 3 OR section_number BETWEEN 5 AND 6 AS hit FROM se), sk AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id) AS any_hit FROM ss),", "SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY old)::INT AS section_number, old, n FROM (SELECT doc_id, section_number AS old, count(*) AS n FROM sk WHERE hit OR NOT any_hit GROUP BY doc_id, section_number)"),
    "code_signals": q(BLOCKS, f"SELECT doc_id, page_number, block_no, round({density('text', WIDE)}, 6) AS wide, round({density('text', NARROW)}, 6) AS narrow, round({indent('text')}, 6) AS indent, round({short('text')}, 6) AS short, {sql_hits('text')} AS sql_hits, len({full('text')}) AS n_lines, mono, round({hits('text', DIGITS)}::DOUBLE / greatest(1, {hits('text', '[A-Za-z0-9]')}), 6) AS numeric, round({density('text', '[.;:!?]')}, 6) AS punctuation FROM bt WHERE block_type = 0"),
    "code_demote": q(DEMOTED, "SELECT d.doc_id, d.section_number, d.pos, d.elem_type, d.text FROM dm d JOIN cl c ON c.doc_id = d.doc_id AND c.pos = d.pos WHERE c.elem_type = 'code_block'"),
    "paragraph_merge": q(DEMOTED + merged_paragraphs("dm"), "SELECT doc_id, section_number, pos, page_number, elem_type, text FROM pz"),
    "column_reflow": q(SECTIONS + reflowed("se"), "SELECT doc_id, section_number, page_number, pos, reading_order_index, elem_type FROM rz"),
    "line_cluster_count": q(LINES, "SELECT doc_id, list_reduce(list_concat([{'s': 0.0::DOUBLE, 'n': 0::BIGINT, 'k': 0::BIGINT}], list_transform(list(length(line)::DOUBLE ORDER BY length(line)), lambda v: {'s': v, 'n': 1::BIGINT, 'k': 0::BIGINT})), lambda a, v: CASE WHEN a.n > 0 AND abs(v.s - a.s / greatest(a.n, 1)) <= 8.0 THEN {'s': a.s + v.s, 'n': a.n + 1, 'k': a.k} ELSE {'s': v.s, 'n': 1::BIGINT, 'k': a.k + 1} END).k AS clusters FROM ml GROUP BY doc_id"),
    "resource_names": q(
        DEMOTED + "rs AS (SELECT doc_id, section_number, page_number, pos, CASE elem_type WHEN 'code_block' THEN 'code_blocks' WHEN 'image' THEN 'images' WHEN 'drawing' THEN 'drawings' END AS resource_kind FROM dm),",
        "SELECT doc_id, section_number, pos, resource_kind, resource_no, 'resources/' || resource_kind || '/' || section_number || '_' || page_number || '_' || resource_kind || '_' || resource_no || '.txt' AS resource_path FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id, section_number, page_number, resource_kind ORDER BY pos))::INT AS resource_no FROM rs WHERE resource_kind IS NOT NULL)",
    ),
    "section_lines": q(DEMOTED + lined("dm"), CONTENT),
    "indent_code": q(
        CLEAN + f"ic AS (SELECT doc_id, pos, {trimmed_lines('text')} AS ls FROM cl WHERE elem_type = 'code_block'),",
        "SELECT doc_id, pos, "
        + ", ".join(
            f"coalesce(list_reduce(list_concat([{{'o': NULL::VARCHAR, 'l': 0::INT}}], list_transform(ls, lambda s: {{'o': s, 'l': 0::INT}})), lambda a, v: {{'o': CASE WHEN a.o IS NULL THEN '' ELSE a.o || {NL} END || repeat('    ', CASE WHEN regexp_matches({up}v.o{down}, '{closes}') THEN greatest(0, a.l - 1) ELSE a.l END) || v.o, 'l': (CASE WHEN regexp_matches({up}v.o{down}, '{closes}') THEN greatest(0, a.l - 1) ELSE a.l END) + CASE WHEN regexp_matches({up}v.o{down}, '{opens}') THEN 1 ELSE 0 END}}).o, '') AS {name}"
            for name, up, down, closes, opens in (("as_sql", "upper(", ")", "^(?:COMMIT|ROLLBACK|END)", "^(?:BEGIN|START TRANSACTION|CASE)"), ("as_braces", "", "", r"^[}\])]", r"[{\[(]$"))
        )
        + " FROM ic",
    ),
}


# ------------------------------------------------------------------ tables


def clusters(xs: str) -> str:
    start = "{'s': 0.0::DOUBLE, 'n': 0::BIGINT, 'k': 0::BIGINT}"
    step = "CASE WHEN a_.n > 0 AND abs(v_.s - a_.s / greatest(a_.n, 1)) <= 8.0 THEN {'s': a_.s + v_.s, 'n': a_.n + 1, 'k': a_.k} ELSE {'s': v_.s, 'n': 1::BIGINT, 'k': a_.k + 1} END"
    return f"list_reduce(list_concat([{start}], list_transform(list_sort(coalesce({xs}, [])), lambda u_: {{'s': u_::DOUBLE, 'n': 1::BIGINT, 'k': 0::BIGINT}})), lambda a_, v_: {step}).k"


REGIONS = (
    LINES
    + r"""
pg AS (SELECT doc_id, (i // 8 + 1)::INT AS page_number FROM ml GROUP BY ALL),
dw AS (SELECT doc_id, page_number, 60.0 AS x0, 100.0 AS y0, 60.0 + CASE WHEN (doc_id + page_number) % 3 = 0 THEN 20.0 ELSE 200.0 END AS x1, 100.0 + CASE WHEN (doc_id + page_number) % 3 = 0 THEN 20.0 ELSE 200.0 END AS y1 FROM pg),
rg AS (SELECT doc_id, page_number, r.* FROM pg, (VALUES (0, 50.0::DOUBLE, 30.0::DOUBLE, 560.0::DOUBLE, 100.0::DOUBLE), (1, 50.0, 30.0, 560.0, 160.0), (2, 300.0, 80.0, 560.0, 160.0)) r(ordinal, x0, y0, x1, y1)),
ws AS (SELECT doc_id, i, unnest(range(len(w))) AS j, unnest(w) AS text FROM (SELECT doc_id, i, list_filter(regexp_split_to_array(line, '[ \t]+'), lambda x: x <> '') AS w FROM ml)),
wp AS (SELECT doc_id, (i // 8 + 1)::INT AS page_number, (i % 8) * 100000 + j AS word_no, i % 8 AS row, text, (CASE WHEN doc_id % 2 = 0 THEN 60.0 + j * 80 ELSE 60.0 + j * (30.0 + i % 7) END)::DOUBLE AS x0, (40.0 + 14.0 * (i % 8))::DOUBLE AS y0 FROM ws),
wx AS (SELECT *, x0 + least(length(text), 10) * 5.0 AS x1, y0 + 10.0 AS y1 FROM wp),
wr AS (SELECT w.*, r.ordinal FROM wx w JOIN rg r ON w.doc_id = r.doc_id AND w.page_number = r.page_number AND w.x0 >= r.x0 AND w.y0 >= r.y0 AND w.x1 <= r.x1 AND w.y1 <= r.y1),
li AS (SELECT doc_id, page_number, ordinal, row, list(x0 ORDER BY x0, word_no) AS xs, list(x1 ORDER BY x0, word_no) AS es, min(x0) AS lo, max(x1) AS hi, max(y1) AS y1, avg((y0 + y1) / 2) AS centre, count(*) AS n, trim(string_agg(text, ' ' ORDER BY x0, word_no)) AS text FROM wr GROUP BY ALL),
lg AS (SELECT *, lead(centre) OVER (PARTITION BY doc_id, page_number, ordinal ORDER BY centre) - centre AS gap FROM li),
la AS (SELECT doc_id, page_number, ordinal, count(*) AS line_count, avg(greatest(0, hi - lo)) AS width, sum(n) AS word_count, CASE WHEN count(*) >= 2 THEN stddev_pop(n) ELSE 0 END AS wcv, list(xs[1]) AS starts, list(es[-1]) AS ends, flatten(list(xs[2:])) AS inner_xs, CASE WHEN count(gap) >= 2 THEN stddev_pop(gap) ELSE 0 END AS rsv FROM lg GROUP BY ALL),
lb AS (SELECT doc_id, page_number, ordinal, string_agg(text, ' ' ORDER BY word_no) AS blob FROM wr GROUP BY ALL),
gd AS (SELECT DISTINCT r.doc_id, r.page_number, r.ordinal FROM rg r JOIN dw d ON r.doc_id = d.doc_id AND r.page_number = d.page_number AND r.x0 < d.x1 AND d.x0 < r.x1 AND r.y0 < d.y1 AND d.y0 < r.y1),
"""
)

SCORES = (
    REGIONS
    + rf"""
mt AS (SELECT rg.*, coalesce(line_count, 0)::BIGINT AS line_count, {clusters("inner_xs")} AS aligned_columns, coalesce(width, 0) / 612.0 AS width_ratio, {hits("coalesce(blob, '')", "[.;:!?]")}::DOUBLE / greatest(1, length(coalesce(blob, ''))) AS punctuation_ratio,
    coalesce(wcv, 0)::DOUBLE AS word_count_variance, {clusters("starts")} <= 1 AS same_left, {clusters("ends")} AS right_clusters, coalesce(rsv, 0)::DOUBLE AS row_spacing_variance,
    {hits("coalesce(blob, '')", DIGITS)}::DOUBLE / greatest(1, {hits("coalesce(blob, '')", "[A-Za-z0-9]")}) AS numeric_ratio, coalesce(word_count, 0)::BIGINT AS word_count, coalesce(word_count, 0)::DOUBLE / (greatest(1, x1 - x0) * greatest(1, y1 - y0)) AS bbox_density, gd.doc_id IS NOT NULL AS grid_lines,
    coalesce(blob, '') AS blob
    FROM rg LEFT JOIN la USING (doc_id, page_number, ordinal) LEFT JOIN lb USING (doc_id, page_number, ordinal) LEFT JOIN gd USING (doc_id, page_number, ordinal)),
mw AS (SELECT *, len(list_filter(regexp_extract_all(lower(blob), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: list_contains([{", ".join(f"'{x}'" for x in STOPWORDS)}], w)))::DOUBLE / greatest(1, len(regexp_extract_all(blob, '[\p{{L}}\p{{M}}\p{{N}}_]+'))) AS stopword_ratio FROM mt),
sr AS (SELECT *, array_to_string(list_filter([CASE WHEN aligned_columns <= 1 THEN 'insufficient_columns' END, CASE WHEN line_count < 3 THEN 'insufficient_rows' END, CASE WHEN width_ratio > 0.75 AND aligned_columns <= 1 THEN 'flowing_paragraph' END], lambda r: r IS NOT NULL), ',') AS reasons FROM mw),
sc AS (SELECT *, (CASE WHEN reasons <> '' THEN -1 ELSE (CASE WHEN aligned_columns >= 2 THEN 3 ELSE 0 END) + (CASE WHEN line_count >= 3 AND row_spacing_variance <= 2.5 THEN 2 ELSE 0 END) + (CASE WHEN right_clusters >= 2 THEN 1 ELSE 0 END) + (CASE WHEN numeric_ratio >= 0.08 THEN 1 ELSE 0 END) + (CASE WHEN grid_lines THEN 4 ELSE 0 END)
    - (CASE WHEN same_left THEN 3 ELSE 0 END) - (CASE WHEN width_ratio > 0.75 THEN 2 ELSE 0 END) - (CASE WHEN punctuation_ratio > 0.03 THEN 2 ELSE 0 END) - (CASE WHEN stopword_ratio > 0.35 THEN 2 ELSE 0 END) - (CASE WHEN word_count_variance > 6 THEN 1 ELSE 0 END) END)::DOUBLE AS score FROM sr),
"""
)

ORACLE |= {
    "table_score": q(SCORES, "SELECT doc_id, page_number, 1000 + ordinal AS region_no, line_count, word_count, same_left, grid_lines, reasons = '' AND score >= 3 AS is_table, score, aligned_columns, right_clusters, round(width_ratio, 6) AS width_ratio, round(punctuation_ratio, 6) AS punctuation_ratio, round(word_count_variance, 6) AS word_count_variance, round(row_spacing_variance, 6) AS row_spacing_variance, round(numeric_ratio, 6) AS numeric_ratio, round(bbox_density, 6) AS bbox_density, reasons FROM sc"),
    "spatial_exists": q(REGIONS, "SELECT doc_id, page_number, 1000 + ordinal AS region_no, gd.doc_id IS NOT NULL AS hit FROM rg LEFT JOIN gd USING (doc_id, page_number, ordinal)"),
    "crop_best": q(
        SCORES
        + """
cb AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id, s.page_number ORDER BY s.score + CASE WHEN s.reasons = '' AND s.score >= 3 THEN 1 ELSE 0 END DESC, s.y0 - s.y1 DESC, s.ordinal) AS k FROM sc s JOIN rg b ON b.doc_id = s.doc_id AND b.page_number = s.page_number AND b.ordinal = 0
    WHERE greatest(0, least(s.x1, b.x1) - greatest(s.x0, b.x0)) / greatest(1, least(s.x1 - s.x0, b.x1 - b.x0)) >= 0.85 AND abs(s.y0 - b.y0) <= 40 AND s.y1 >= b.y1 AND NOT (s.stopword_ratio > 0.32 AND s.punctuation_ratio > 0.018 AND s.word_count > 40)),
""",
        "SELECT b.doc_id, b.page_number, 1 AS base_no, coalesce(c.ordinal, 0) AS ordinal, coalesce(c.x0, b.x0) AS x0, coalesce(c.y0, b.y0) AS y0, coalesce(c.x1, b.x1) AS x1, coalesce(c.y1, b.y1) AS y1 FROM rg b LEFT JOIN cb c ON c.doc_id = b.doc_id AND c.page_number = b.page_number AND c.k = 1 WHERE b.ordinal = 0",
    ),
    "table_trim": q(
        REGIONS
        + rf"""
tl AS (SELECT *, len(list_filter(list_transform(range(1, len(xs)), lambda k: xs[k + 1] - es[k] >= 12.0), lambda g: g)) AS gaps, {clusters("xs[2:]")} AS cols, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS wc FROM li WHERE ordinal = 1),
tt AS (SELECT *, ((cols >= 1 AND gaps >= 1 AND wc >= 2) OR (wc <= 6 AND gaps >= 1) OR ({hits("text", DIGITS)}::DOUBLE / greatest(1, {hits("text", "[A-Za-z0-9]")}) >= 0.08 AND wc >= 2)) AND NOT (wc >= 10 AND regexp_matches(text, '[.;:]$')) AS t FROM tl),
ts AS (SELECT *, max(t::INT) OVER w = 1 AND NOT t AS bad FROM tt WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY row)),
tu AS (SELECT *, bad AND coalesce(lag(bad) OVER (PARTITION BY doc_id, page_number ORDER BY row), false) AS stop FROM ts),
tv AS (SELECT *, max(stop::INT) OVER (PARTITION BY doc_id, page_number ORDER BY row) = 1 AS past FROM tu),
tw AS (SELECT doc_id, page_number, arg_max(y1, row) AS last FROM tv WHERE t AND NOT past GROUP BY ALL),
""",
        "SELECT r.doc_id, r.page_number, 1 AS base_no, r.x0, r.y0, r.x1, CASE WHEN last IS NULL THEN r.y1 ELSE least(r.y1, greatest(b.y1, last + 4.0)) END AS y1 FROM rg r JOIN rg b ON b.doc_id = r.doc_id AND b.page_number = r.page_number AND b.ordinal = 0 LEFT JOIN tw ON tw.doc_id = r.doc_id AND tw.page_number = r.page_number WHERE r.ordinal = 1",
    ),
}

# ------------------------------------------------------------------ scenes

USERS = """
us AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS scene_id, user_id AS u FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
mv AS (SELECT scene_id, 'u' || u AS name, ['straight', 'bent', 'curve'][(u % 3 + 1)::INT] AS kind, (u % 7)::DOUBLE AS bx, (u % 4)::DOUBLE AS by_, 0.25 * (u % 4 + 1)::DOUBLE AS duration, u % 3 AS rep, u % 2 = 0 AS rev FROM us WHERE u % 3 <> 0),
"""

ORACLE |= {
    "movement_paths": q(
        USERS
        + """
pt AS (SELECT *, CASE kind WHEN 'straight' THEN [[0.0, 0.0], [bx, by_]] WHEN 'bent' THEN [[0.0, 0.0], [bx / 2, 0.0], [bx / 2, greatest(0.8, by_, bx / 2)], [bx, by_]]
    ELSE list_transform(range(13), lambda i: [2 * (1 - i / 12.0::DOUBLE) * (i / 12.0::DOUBLE) * (bx / 2) + (i / 12.0::DOUBLE) * (i / 12.0::DOUBLE) * bx, 2 * (1 - i / 12.0::DOUBLE) * (i / 12.0::DOUBLE) * (by_ / 2 + greatest(1.0, bx, by_) / 2) + (i / 12.0::DOUBLE) * (i / 12.0::DOUBLE) * by_]) END AS way FROM mv),
lg AS (SELECT scene_id, name, duration, rev, way, unnest(range(1, rep * CASE WHEN rev THEN 2 ELSE 1 END + 1)) AS path_no FROM pt),
lp AS (SELECT scene_id, name, duration, path_no, CASE WHEN rev AND path_no % 2 = 0 THEN list_reverse(way) ELSE way END AS way FROM lg),
""",
        "SELECT scene_id, name, path_no, duration::DOUBLE AS duration, k, round(p[1]::DOUBLE, 6) AS x, round(p[2]::DOUBLE, 6) AS y FROM (SELECT scene_id, name, path_no, duration, unnest(range(len(way))) AS k, unnest(way) AS p FROM lp)",
    ),
    "scene_timeline": q(
        USERS
        + """
st AS (SELECT strftime(ts, '%Y-%m-%d') AS scene_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS step_no, user_id AS u, value, CASE event_type WHEN 'signup' THEN 'spawn' WHEN 'click' THEN 'move' WHEN 'view' THEN 'idle' WHEN 'purchase' THEN 'wait' WHEN 'error' THEN 'close' END AS action FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
ac AS (SELECT *, coalesce(last_value(CASE WHEN action IN ('spawn', 'close') THEN action = 'spawn' END IGNORE NULLS) OVER past, false) AS there,
    coalesce(last_value(CASE WHEN action IN ('spawn', 'close') THEN action = 'spawn' END IGNORE NULLS) OVER upto, false) AS after_,
    coalesce(last_value(CASE WHEN action = 'idle' AND u % 2 = 0 THEN true WHEN action = 'close' THEN false END IGNORE NULLS) OVER upto, false) AS idle FROM st WHERE action <> 'wait'
    WINDOW past AS (PARTITION BY scene_id, u ORDER BY step_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), upto AS (PARTITION BY scene_id, u ORDER BY step_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ar AS (SELECT *, CASE action WHEN 'spawn' THEN true WHEN 'close' THEN there WHEN 'move' THEN there AND u % 3 <> 0 ELSE u % 2 = 0 END AS runs, (idle AND after_)::INT AS on_ FROM ac),
ad AS (SELECT *, on_ - coalesce(lag(on_) OVER (PARTITION BY scene_id, u ORDER BY step_no), 0) AS change,
    CASE WHEN runs THEN CASE action WHEN 'spawn' THEN 0.5 * (u % 3 + 1) WHEN 'close' THEN 0.25 * (u % 2 + 1) WHEN 'move' THEN (u % 3) * (CASE WHEN u % 2 = 0 THEN 2 ELSE 1 END) * 0.25 * (u % 4 + 1) END END::DOUBLE AS act_s FROM ar),
tm AS (SELECT s.scene_id, s.step_no, s.action, greatest(0.0, coalesce(s.value, 0) / 100)::DOUBLE AS wait, a.act_s, coalesce(a.runs, false)::INT AS played, sum(coalesce(a.change, 0)) OVER (PARTITION BY s.scene_id ORDER BY s.step_no) AS active_idle FROM st s LEFT JOIN ad a USING (scene_id, step_no)),
tr AS (SELECT *, CASE WHEN action = 'wait' THEN CASE WHEN active_idle > 0 THEN wait ELSE 0 END ELSE coalesce(act_s, 0) END AS run_s FROM tm),
""",
        "SELECT scene_id, step_no::INT AS step_no, action, round(run_s, 6) AS run_s, round(CASE WHEN action = 'wait' THEN wait + run_s ELSE run_s END, 6) AS wall_s, round(coalesce(sum(run_s) OVER (PARTITION BY scene_id ORDER BY step_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS start_s, played::BIGINT AS played, active_idle::BIGINT AS active_idle FROM tr",
    ),
    "scene_elements": """
SELECT * FROM (VALUES
('GATE', 'shape', 'rectangle', NULL, 'Gate', '[0.0,1.0]', NULL, NULL, 1.25::DOUBLE, '#ff8800', 'shape_popup', NULL, NULL, NULL::INT),
('LOGO', 'image', NULL, 'pics/logo.png', NULL, '[3.0,-1.0]', NULL, NULL, NULL, NULL, 'image_popup', NULL, NULL, NULL),
('WIRE', 'arrow', 'bidirectional_dotted', NULL, NULL, NULL, '[0.0,0.0]', '[2.0,0.0]', NULL, NULL, 'bidirectional_dotted_spawn', 'dotted_bidirectional_idle', NULL, NULL),
('PULSE', 'shape', 'circle', NULL, NULL, '[9.0,9.0]', NULL, NULL, 0.5, NULL, 'shape_popup', NULL, '[[1.0,1.0],[3.0,2.0]]', 2),
('SWING', 'shape', 'blob', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '[[0.0,0.0],[2.0,0.0]]', 1)
) t(name, type, shape, url, text, position, from_position, to_position, size, fill_color, spawn, idle, path, repeat)""",
    "scene_steps": """
SELECT * FROM (VALUES (1, 'spawn', 'GATE', 'GATE,LOGO', NULL::DOUBLE), (2, 'wait', NULL, NULL, 0.5), (3, 'idle', 'WIRE', NULL, NULL), (4, 'spawn', 'WIRE', 'WIRE', NULL), (5, 'wait', NULL, NULL, 0.25),
(6, 'move', 'PULSE', NULL, NULL), (7, 'spawn', 'PULSE', 'PULSE,NOBODY', NULL), (8, 'move', 'PULSE', NULL, NULL), (9, 'move', 'SWING', NULL, NULL), (10, 'spawn', 'SWING', 'SWING', NULL), (11, 'move', 'SWING', NULL, NULL),
(12, 'close', 'WIRE', 'WIRE', NULL), (13, 'wait', NULL, NULL, 0.125), (14, 'close', 'PULSE', 'PULSE,GATE,LOGO', NULL), (15, 'close', 'NOBODY', 'NOBODY', NULL)) t(step_no, action, target, targets, duration)""",
    "scene_play": """
SELECT * FROM (VALUES (1, 'spawn', 0.5::DOUBLE, 0.5::DOUBLE, 0.0::DOUBLE), (2, 'wait', 0.0, 0.5, 0.5), (3, 'idle', 0.0, 0.0, 0.5), (4, 'spawn', 1.5, 1.5, 0.5), (5, 'wait', 0.25, 0.5, 2.0), (6, 'move', 0.0, 0.0, 2.25),
(7, 'spawn', 0.25, 0.25, 2.25), (8, 'move', 2.0, 2.0, 2.5), (9, 'move', 0.0, 0.0, 4.5), (10, 'spawn', 0.5, 0.5, 4.5), (11, 'move', 0.75, 0.75, 5.0), (12, 'close', 0.5, 0.5, 5.75), (13, 'wait', 0.0, 0.125, 6.25),
(14, 'close', 0.75, 0.75, 6.25), (15, 'close', 0.0, 0.0, 7.0)) t(step_no, action, run_s, wall_s, start_s)""",
    "element_defaults": """
SELECT * FROM (VALUES ('GATE', 'rectangle', 1.25::DOUBLE, 2.5::DOUBLE, 'Gate', 'WHITE', NULL::DOUBLE, 'fade_in', 0.5::DOUBLE, NULL, 'fade_out', 0.0::DOUBLE), ('LOGO', 'image', 1.5, 1.5, 'LOGO', 'WHITE', NULL, 'fade_in', 0.25, NULL, 'fade_out', 0.0),
('WIRE', 'bidirectional_dotted', NULL, NULL, NULL, 'WHITE', round(-pi() / 4 - 1.5708, 6), 'bidirectional_dotted_spawn', 1.5, 'dotted_bidirectional_idle', 'fade_out', 0.0), ('PULSE', 'circle', 1.0, 1.0, NULL, 'WHITE', NULL, 'fade_in', 0.25, NULL, 'fade_out', 2.0),
('SWING', 'square', 1.6, 1.6, NULL, 'RED', NULL, 'fade_in', 0.5, NULL, 'fade_out', 0.75))
t(name, drawable, width, height, text, border_color, angle, spawn, spawn_s, idle, remove, move_s)""",
    "scene_json": """
SELECT 'flow.render.json' AS file, array_to_string([
'{', '  "elements": [',
'    {', '      "name": "GATE",', '      "type": "shape",', '      "shape": "rectangle",', '      "text": "Gate",', '      "position": [', '        0.0,', '        1.0', '      ],', '      "size": 1.25,', '      "fill_color": "#ff8800",',
'      "spawn_animation": {', '        "type": "shape_popup",', '        "duration": 0.5', '      },', '      "remove_animation": {', '        "type": "shape_popout",', '        "duration": 0.75', '      }', '    },',
'    {', '      "name": "LOGO",', '      "type": "image",', '      "url": "pics/logo.png",', '      "position": [', '        3.0,', '        -1.0', '      ],', '      "spawn_animation": {', '        "type": "image_popup",', '        "duration": 0.25', '      }', '    },',
'    {', '      "name": "WIRE",', '      "type": "arrow",', '      "shape": "bidirectional_dotted",', '      "from": [', '        0.0,', '        0.0', '      ],', '      "to": [', '        2.0,', '        0.0', '      ],', '      "path": [', '        [', '          1.0,', '          1.0', '        ]', '      ],',
'      "spawn_animation": {', '        "type": "bidirectional_dotted_spawn",', '        "duration": 1.5', '      },', '      "idle_animation": {', '        "type": "dotted_bidirectional_idle",', '        "duration": 1.0', '      },', '      "remove_animation": {', '        "type": "no_such_removal",', '        "duration": 2.0', '      }', '    },',
'    {', '      "name": "PULSE",', '      "type": "shape",', '      "shape": "circle",', '      "position": [', '        9.0,', '        9.0', '      ],', '      "size": 0.5,', '      "spawn_animation": {', '        "type": "shape_popup",', '        "duration": 0.25', '      },',
'      "movement": {', '        "type": "bent",', '        "path": [', '          [', '            1.0,', '            1.0', '          ],', '          [', '            3.0,', '            2.0', '          ]', '        ],', '        "duration": 0.5,', '        "repeat": 2,', '        "reverse": true', '      }', '    },',
'    {', '      "name": "SWING",', '      "type": "shape",', '      "shape": "blob",', '      "border_color": "RED",', '      "movement": {', '        "type": "downwardscurve",', '        "path": [', '          [', '            0.0,', '            0.0', '          ],', '          [', '            2.0,', '            0.0', '          ]', '        ],', '        "duration": 0.75,', '        "repeat": 1,', '        "reverse": false', '      }', '    }',
'  ],', '  "sequence": [',
'    {', '      "action": "spawn",', '      "target": "GATE",', '      "targets": [', '        "GATE",', '        "LOGO"', '      ]', '    },', '    {', '      "action": "wait",', '      "duration": 0.5', '    },', '    {', '      "action": "idle",', '      "target": "WIRE"', '    },',
'    {', '      "action": "spawn",', '      "target": "WIRE",', '      "targets": [', '        "WIRE"', '      ]', '    },', '    {', '      "action": "wait",', '      "duration": 0.25', '    },', '    {', '      "action": "move",', '      "target": "PULSE"', '    },',
'    {', '      "action": "spawn",', '      "target": "PULSE",', '      "targets": [', '        "PULSE",', '        "NOBODY"', '      ]', '    },', '    {', '      "action": "move",', '      "target": "PULSE"', '    },', '    {', '      "action": "move",', '      "target": "SWING"', '    },',
'    {', '      "action": "spawn",', '      "target": "SWING",', '      "targets": [', '        "SWING"', '      ]', '    },', '    {', '      "action": "move",', '      "target": "SWING"', '    },', '    {', '      "action": "close",', '      "target": "WIRE",', '      "targets": [', '        "WIRE"', '      ]', '    },',
'    {', '      "action": "wait",', '      "duration": 0.125', '    },', '    {', '      "action": "close",', '      "target": "PULSE",', '      "targets": [', '        "PULSE",', '        "GATE",', '        "LOGO"', '      ]', '    },', '    {', '      "action": "close",', '      "target": "NOBODY",', '      "targets": [', '        "NOBODY"', '      ]', '    }',
'  ]', '}', ''], chr(10)) AS json""",
    "coercions": """
WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k, '"' || event_type || CASE WHEN event_id % 2 = 0 THEN '"' ELSE '' END AS quoted FROM events)
SELECT event_id, coalesce(try_cast(k AS DOUBLE), 0.45::DOUBLE) AS number, greatest(1, coalesce(try_cast(CASE WHEN event_id % 3 > 0 THEN k ELSE 'x' END AS INT), 1))::BIGINT AS whole,
    CASE WHEN event_id % 4 = 0 THEN true WHEN event_id % 4 = 2 THEN k IN ('1') ELSE false END AS flag, regexp_replace(quoted, '^"(.*)"$', '\\1') AS plain FROM e""",
}


# ------------------------------------------------------------------ split code


def artifact_in_code(t: str) -> str:
    s = single(t)
    return rf"({s} = '' OR (length({s}) <= 90 AND (regexp_matches({s}, '\|\s*\d{{1,4}}\s*$') OR regexp_matches({s}, '(?i)^\d{{1,4}}\s*\|\s*chapter\b') OR regexp_matches({s}, '^\d{{1,4}}\s*\|\s*[A-Za-z][\p{{L}}\p{{M}}\p{{N}}_\s\-:,]+$') OR regexp_matches({s}, '(?i)^chapter\s+\d+\b'))))"


def goes_on(a: str, b: str) -> str:
    loose = lambda t: share(t, r"regexp_matches(z_, '^[ \t]')")
    ends = r"[{(\[:\\,.]$"
    begins = r"^(?:else|elif|except|catch|finally|\.|\)|\]|\}|&&|\|\||\+|-|\*|/|%|=>|->|::)"
    alike = f"(abs({loose(a)} - {loose(b)}) <= 0.25 AND abs({density(a, WIDE)} - {density(b, WIDE)}) <= 0.06)"
    return rf"({strip(a)} <> '' AND {strip(b)} <> '' AND (regexp_matches({rstrip(a)}, '{ends}') OR regexp_matches(lower(regexp_replace({b}, '^\s+', '')), '{begins}') OR {alike}))"


STATE = "{'page': v_.page, 'role': v_.role, 'ok': v_.ok, 'follows': v_.follows, 'pos': v_.pos, 'b': CASE WHEN %s THEN a_.b WHEN v_.role = 'code' THEN v_.pos END, 'bp': CASE WHEN %s THEN a_.bp WHEN v_.role = 'code' THEN v_.page END, 'o': list_append(a_.o, CASE WHEN %s THEN a_.b WHEN v_.role = 'code' THEN v_.pos END)}"
STAYS = "(a_.b IS NOT NULL AND (v_.role = 'skip' OR (v_.role = 'code' AND (v_.page = a_.bp OR v_.ok)) OR (v_.role = 'tiny' AND v_.follows IS NOT NULL AND (v_.follows = a_.bp OR v_.follows = -1))))"

MERGED = rf"""
cr AS (SELECT *, CASE WHEN elem_type IN ('heading', 'caption', 'image', 'table', 'drawing') THEN 'hard' WHEN elem_type IN ('link', 'annotation') OR (elem_type = 'paragraph' AND {artifact_in_code("text")}) THEN 'skip'
    WHEN elem_type = 'code_block' THEN 'code' WHEN elem_type = 'paragraph' AND {tiny("text")} THEN 'tiny' ELSE 'other' END AS role,
    last_value(CASE WHEN elem_type = 'code_block' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id, section_number ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM dm),
co AS (SELECT *, coalesce(role = 'code' AND {goes_on("prev", "text")}, false) AS ok FROM cr),
cn AS (SELECT *, lead(CASE WHEN role = 'code' THEN CASE WHEN ok THEN -1 ELSE page_number END END) OVER (PARTITION BY doc_id, section_number ORDER BY pos) AS follows FROM co),
cf AS (SELECT doc_id, section_number, list(pos ORDER BY pos) AS ps, list_reduce(list_concat([{{'page': 0::INT, 'role': '', 'ok': false, 'follows': NULL::INT, 'pos': NULL::BIGINT, 'b': NULL::BIGINT, 'bp': NULL::INT, 'o': []::BIGINT[]}}],
    list({{'page': page_number, 'role': role, 'ok': ok, 'follows': follows::INT, 'pos': pos, 'b': NULL::BIGINT, 'bp': NULL::INT, 'o': []::BIGINT[]}} ORDER BY pos)), lambda a_, v_: {STATE % (STAYS, STAYS, STAYS)}).o AS bases FROM cn GROUP BY ALL),
cb AS (SELECT doc_id, section_number, unnest(ps) AS pos, unnest(bases) AS base FROM cf),
cj AS (SELECT cn.*, base, count(CASE WHEN role = 'code' THEN 1 END) OVER (PARTITION BY doc_id, section_number, base) AS n_code FROM cn JOIN cb USING (doc_id, section_number, pos)),
ct AS (SELECT doc_id, section_number, base AS pos, string_agg(rtrim(text, {NL}), {NL} ORDER BY pos) FILTER (rtrim(text, {NL}) <> '') AS whole FROM cj WHERE base IS NOT NULL AND n_code > 1 AND role = 'code' GROUP BY doc_id, section_number, base),
mc AS (SELECT * EXCLUDE (text, whole, role, prev, ok, follows, base, n_code), coalesce(whole, text) AS text FROM cj LEFT JOIN ct USING (doc_id, section_number, pos) WHERE base IS NULL OR n_code = 1 OR pos = base),
"""
ORACLE["code_merge"] = q(DEMOTED + MERGED, "SELECT doc_id, section_number, pos, page_number, elem_type, text FROM mc")

CHOSEN = """
sq AS (SELECT * EXCLUDE (hit, any_hit) FROM (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id) AS any_hit FROM (SELECT *, section_number BETWEEN 15 AND 238 AS hit FROM se)) WHERE hit OR NOT any_hit),
"""
RENUMBERED = """
nm AS (SELECT * EXCLUDE (section_number), (dense_rank() OVER (PARTITION BY doc_id ORDER BY section_number))::INT AS section_number FROM rz),
"""
ORACLE["document_flow"] = q(SECTIONS + CHOSEN + DEMOTED.removeprefix(SECTIONS).replace("FROM se WHERE", "FROM sq WHERE") + MERGED + merged_paragraphs("mc") + reflowed("pz") + RENUMBERED + lined("nm"), CONTENT)

# ------------------------------------------------------------------ scans, chunks, crops and stored code

SCANS = ORDERED + """
sn AS (SELECT doc_id, page_number, n AS n_blocks, doc_id + page_number AS n FROM pg),
sx AS (SELECT doc_id, page_number, n_blocks, 1 AS src, 0 AS p, 'drawing' AS elem_type, 60.0 AS x0, 100.0 AS y0, 60.0 + CASE WHEN n % 3 = 0 THEN 20.0 ELSE 200.0 END AS x1, 100.0 + CASE WHEN n % 3 = 0 THEN 20.0 ELSE 200.0 END AS y1, NULL::INT AS row_count, NULL::INT AS column_count, (n % 5)::INT AS item_count, NULL::VARCHAR AS uri, NULL::INT AS destination_page, NULL::VARCHAR AS kind, NULL::VARCHAR AS content FROM sn
    UNION ALL SELECT doc_id, page_number, n_blocks, 2, 0, 'table', CASE WHEN n % 12 = 0 THEN 0 ELSE 10 END, CASE WHEN n % 12 = 0 THEN 0 ELSE 20 END, CASE WHEN n % 12 = 0 THEN 0 ELSE 316 END, CASE WHEN n % 12 = 0 THEN 0 ELSE 416 END, CASE WHEN n % 3 = 1 THEN 0 ELSE n % 3 + 2 END, CASE WHEN n % 8 = 0 THEN 2 ELSE n % 5 END, NULL, NULL, NULL, NULL, NULL FROM sn WHERE n % 4 = 0
    UNION ALL SELECT doc_id, page_number, n_blocks, 3, 0, 'link', 5, 6, 50, 16, NULL, NULL, NULL, 'https://example.org/' || n, NULL, NULL, NULL FROM sn WHERE n % 2 = 0
    UNION ALL SELECT doc_id, page_number, n_blocks, 3, 1, 'link', 0, 0, 0, 0, NULL, NULL, NULL, NULL, n % 7, NULL, NULL FROM sn WHERE n % 2 = 0
    UNION ALL SELECT doc_id, page_number, n_blocks, 4, 0, 'annotation', 1, 700, 90, 720, NULL, NULL, NULL, NULL, NULL, 'Highlight', CASE WHEN n % 2 = 1 THEN 'note ' || n END FROM sn WHERE n % 3 = 1),
sy AS (SELECT *, (n_blocks + row_number() OVER (PARTITION BY doc_id, page_number ORDER BY src, p) - 1)::INT AS idx FROM sx),
"""
ORACLE |= {
    "page_scan": q(SCANS, "SELECT doc_id, page_number, idx AS reading_order_index, elem_type, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, row_count::INT AS row_count, column_count::INT AS column_count, item_count, uri, destination_page::INT AS destination_page, kind, content FROM sy"),
    "scan_lines": q(SCANS, "SELECT doc_id, page_number, idx::BIGINT AS pos, CASE elem_type WHEN 'table' THEN 'TABLE resources/tables/1_' || page_number || '_tables_1.txt' WHEN 'link' THEN 'LINK uri=' || coalesce(uri, 'None') || ' destination_page=' || coalesce(destination_page::INT::VARCHAR, 'None') ELSE 'ANNOTATION kind=' || kind || ' content=' || coalesce(content, 'None') END AS line FROM sy WHERE elem_type <> 'drawing'"),
    "chunk_read": q(LINES, "SELECT doc_id, ((i // 8) // 3 * 3 + 1)::INT AS start_page, least((i // 8) // 3 * 3 + 3, any_value(total))::INT AS end_page, sum(CASE WHEN k BETWEEN 4 AND 9 THEN 2 ELSE 1 END)::BIGINT AS n_blocks, max(i // 8 + 1)::INT AS last_page FROM (SELECT *, max(i) OVER (PARTITION BY doc_id) // 8 + 1 AS total FROM ml) GROUP BY doc_id, (i // 8) // 3"),
    "crop_clip": q(REGIONS, "SELECT doc_id, page_number, 10 + ordinal AS base_no, greatest(0.0, x0 - 55)::DOUBLE AS x0, greatest(0.0, y0 - 40)::DOUBLE AS y0, least(500 + doc_id % 3 * 50, x1)::DOUBLE AS x1, least(90 + page_number % 4 * 30, y1)::DOUBLE AS y1 FROM rg"),
    "code_resources": f"""
SELECT event_id, ext, CASE ext WHEN 'json' THEN '{{' || {NL} || '  "k": ' || json_extract_string(props, '$.k') || {NL} || '}}' WHEN 'sql' THEN 'begin' || {NL} || '    select ' || event_id || ';' || {NL} || 'commit' ELSE 'f(' || event_id || ') {{' || {NL} || '    y;' || {NL} || '}}' END AS content
FROM (SELECT *, ['json', 'sql', 'txt'][(event_id % 3 + 1)::INT] AS ext FROM events WHERE event_id IS NOT NULL)""",
}

ORACLE["scene_stream"] = ORACLE["scene_timeline"]
ORACLE["chunk_source"] = ORACLE["chunk_read"]
_FLOW = SECTIONS + CHOSEN + DEMOTED.removeprefix(SECTIONS).replace("FROM se WHERE", "FROM sq WHERE") + MERGED + merged_paragraphs("mc") + reflowed("pz") + RENUMBERED
ORACLE["section_files"] = q(
    _FLOW + lined("nm") + f"""ft AS ({CONTENT}),
fk AS (SELECT doc_id, section_number, page_number, pos, CASE elem_type WHEN 'code_block' THEN 'code_blocks' WHEN 'image' THEN 'images' WHEN 'drawing' THEN 'drawings' END AS kind FROM nm),
fn AS (SELECT doc_id, 'resources/' || kind || '/' || section_number || '_' || page_number || '_' || kind || '_' || row_number() OVER (PARTITION BY doc_id, section_number, page_number, kind ORDER BY pos) || '.txt' AS path FROM fk WHERE kind IS NOT NULL),""",
    "SELECT doc_id, 'section_' || section_number || '.txt' AS path, md5(content) AS md5 FROM ft UNION ALL SELECT doc_id, path, NULL FROM fn",
)
ORACLE["chosen_sections"] = q(
    SECTIONS + """
cr AS (SELECT user_id AS doc_id, least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT user_id, event_id % 7 + 1 + floor(value)::BIGINT % 3 AS a, event_id % 7 + 1 AS b FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND event_id IS NOT NULL)),
cs AS (SELECT doc_id, section_number, count(*) AS n FROM se GROUP BY ALL),
ch AS (SELECT *, EXISTS (SELECT 1 FROM cr WHERE cr.doc_id = cs.doc_id AND cs.section_number BETWEEN lo AND hi) AS hit FROM cs),
ca AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id) AS any_hit FROM ch),""",
    "SELECT doc_id, section_number, (row_number() OVER (PARTITION BY doc_id ORDER BY section_number))::INT AS kept_number, n FROM ca WHERE hit OR NOT any_hit",
)
ORACLE["recurring_texts"] = q(
    BLOCKS + f"""
ra AS (SELECT doc_id, page_number, block_no, x0, y0, {single("text")} AS text FROM bt WHERE block_type = 0 AND {strip("coalesce(text, '')")} <> ''),
rb AS (SELECT doc_id, page_number, text, 'top' AS band, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, block_no) AS place FROM ra
       UNION ALL SELECT doc_id, page_number, text, 'bottom', row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0 DESC, x0 DESC, block_no DESC) FROM ra),
rc AS (SELECT doc_id, page_number, band, place::INT AS place, regexp_replace(text, '[0-9]+', '#', 'g') AS text, try_cast(nullif(regexp_extract(text, '[0-9]{{1,9}}$'), '') AS BIGINT) - page_number AS shift FROM rb WHERE place <= 2),
rd AS (SELECT doc_id, band, place, text, shift, count(*) AS n, min(page_number) AS first_page, max(page_number) AS last_page FROM rc GROUP BY ALL),
re AS (SELECT doc_id, band, place, text, sum(n)::BIGINT AS n_pages, min(first_page) AS first_page, max(last_page) AS last_page, max({{'n': n, 's': -shift}}) FILTER (shift IS NOT NULL) AS m FROM rd GROUP BY ALL),""",
    "SELECT doc_id, band, place, text, n_pages, first_page, last_page, -m.s AS shift FROM re WHERE n_pages >= 2 AND (m IS NULL OR m.n >= 0.8 * n_pages)",
)
ORACLE["table_detect"] = q(
    REGIONS + """
ta AS (SELECT *, CASE WHEN y0 < max(y1) OVER (PARTITION BY doc_id, page_number ORDER BY y0, y1, x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM wx),
tb AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page_number ORDER BY y0, y1, x0, x1 ROWS UNBOUNDED PRECEDING) AS band FROM ta),
tc AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page_number, band ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM tb),
td AS (SELECT doc_id, page_number, band, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, coalesce(list({'a': reach, 'b': x0} ORDER BY x0) FILTER (x0 - reach >= 12), []) AS white FROM tc GROUP BY ALL),
te AS (SELECT doc_id, page_number, band, band AS first, (len(white) > 0)::INT AS n, white FROM td WHERE band = 1
       UNION ALL SELECT doc_id, page_number, band, CASE WHEN goes THEN first ELSE band END, CASE WHEN goes THEN n + 1 ELSE (len(own) > 0)::INT END, CASE WHEN goes THEN kept ELSE own END FROM (
           SELECT *, n > 0 AND len(kept) > 0 AS goes FROM (SELECT d.doc_id, d.page_number, d.band, e.first, e.n, d.white AS own,
               list_filter(flatten(list_transform(e.white, lambda p: list_transform(d.white, lambda w: {'a': greatest(p.a, w.a), 'b': least(p.b, w.b)}))), lambda v: v.b - v.a >= 12) AS kept
               FROM te e JOIN td d ON d.doc_id = e.doc_id AND d.page_number = e.page_number AND d.band = e.band + 1))),
tf AS (SELECT doc_id, page_number, first, max(band) AS last, arg_max(n, band) AS n, arg_max(len(white), band) + 1 AS columns FROM te GROUP BY ALL),""",
    "SELECT f.doc_id, f.page_number, (row_number() OVER (PARTITION BY f.doc_id, f.page_number ORDER BY first) - 1)::INT AS position, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, n::INT AS row_count, columns::INT AS column_count FROM tf f JOIN td d ON d.doc_id = f.doc_id AND d.page_number = f.page_number AND d.band BETWEEN first AND last WHERE n >= 3 GROUP BY f.doc_id, f.page_number, first, n, columns",
)
ORACLE["merge_origins"] = q(DEMOTED + MERGED + merged_paragraphs("mc"), "SELECT doc_id, count(*) AS n_elements, coalesce(sum(length(text)), 0)::BIGINT AS n_chars, 0::BIGINT AS n_wrong, 0::BIGINT AS n_unaccounted, 0::BIGINT AS n_lost FROM pz WHERE text IS NOT NULL GROUP BY doc_id")
ORACLE["outline_sql"] = ORACLE["section_listing"]
ORACLE["stage_figures"] = q(
    DEMOTED + MERGED + merged_paragraphs("mc"),
    " UNION ALL ".join(f"SELECT '{name}' AS stage, count(*) AS n_rows, coalesce(sum(length(text)), 0)::BIGINT AS n_chars FROM {cte}" for name, cte in (("elements", "od"), ("sections", "se"), ("clean", "cl"), ("demoted", "dm"), ("code", "mc"), ("paragraphs", "pz"))),
)
ORACLE["image_payloads"] = q(
    CLEAN + "ix AS (SELECT doc_id, i AS image_xref, md5('img' || line) AS md5, CASE WHEN i % 2 = 0 THEN 'jpg' ELSE 'gif' END AS ext FROM ml WHERE i % 3 <> 0),",
    "SELECT c.doc_id, section_number, pos, c.image_xref, coalesce(ext, c.image_ext, 'png') AS image_ext, md5 FROM cl c LEFT JOIN ix ON ix.doc_id = c.doc_id AND ix.image_xref = c.image_xref WHERE elem_type = 'image'",
)
