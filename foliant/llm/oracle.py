"""DuckDB SQL of the queries that SQL can express."""

WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = rf"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE AS total, coalesce(sum(cap) OVER below, 0) AS fixed, sum(w) OVER rest AS free, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k FROM r
      WINDOW below AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT arg_min((total - fixed) / free, k) FILTER ((total - fixed) / free <= cap / w) AS level FROM o),
t AS (SELECT source, source_size, round(least(cap, coalesce(level, 0) * w), 6) AS target FROM o, v),
m AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
      ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '') || '|' || md5(coalesce(d.text, ''))), 1, 12))::BIGINT AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT source, draw, sum(size)::BIGINT AS n, any_value((rate - floor(rate)) * source_size) AS extra FROM m GROUP BY source, draw),
c AS (SELECT source, draw, extra, (sum(n) OVER (PARTITION BY source ORDER BY draw))::DOUBLE - n / 2.0::DOUBLE AS mid FROM g),
x AS (SELECT source, max(draw) AS last FROM c WHERE mid < extra GROUP BY source)
SELECT m.doc_id, m.source, m.size, m.source_size, m.target, (m.size * (floor(m.rate) + CASE WHEN m.draw <= coalesce(x.last, -1) THEN 1 ELSE 0 END))::BIGINT AS taken FROM m LEFT JOIN x ON m.source IS NOT DISTINCT FROM x.source
"""

OP4 = """
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
b AS (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, (length(h) // 2 + 8)::BIGINT AS size, coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1) AS key,
      xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS text_crc32 FROM b, t),
n AS (SELECT sum(size)::BIGINT AS total FROM d),
k AS (SELECT key, sum(size)::BIGINT AS bytes FROM d GROUP BY key),
q AS (SELECT key, bytes, row_number() OVER (ORDER BY bytes DESC, key) AS r FROM k, n WHERE bytes > greatest(1.0, least(0.02 * total / 24, 268435456.0))),
l AS (SELECT 0::BIGINT AS r, list_transform(range(24), lambda i: 0::BIGINT) AS held, NULL::BIGINT AS key, NULL::INT AS home
      UNION ALL SELECT r, CASE WHEN fits THEN list_transform(held, lambda x, i: CASE WHEN i = s THEN x + bytes ELSE x END) ELSE held END, key, CASE WHEN fits THEN s - 1 ELSE -1 END
      FROM (SELECT q.r, q.key, q.bytes, l.held, list_position(l.held, list_min(l.held))::INT AS s, (list_min(l.held) + q.bytes) * 2400 <= 102 * n.total AS fits FROM l JOIN q ON q.r = l.r + 1, n)),
h AS (SELECT held FROM l ORDER BY r DESC LIMIT 1),
o AS (SELECT list_transform(range(24), lambda s: list_sum(list_transform(held[1:s + 1], lambda x: greatest(0, total - 24 * x)))::BIGINT) AS room, (total - list_sum(held))::DOUBLE AS rest FROM h, n),
e AS (SELECT list_transform(room[1:23], lambda x: rest * x / greatest(1, room[24])) AS ends FROM o),
g AS (SELECT d.*, coalesce(l.home, -1) AS home, CASE WHEN l.key IS NULL THEN 0 ELSE coalesce(doc_id, 0) END AS sub FROM d LEFT JOIN l ON d.key = l.key),
p AS (SELECT *, sum(CASE WHEN home < 0 THEN size ELSE 0 END) OVER (ORDER BY key, sub) - sum(CASE WHEN home < 0 THEN size ELSE 0 END) OVER (PARTITION BY key, sub) / 2 AS mid FROM g),
a AS (SELECT *, CASE WHEN home >= 0 THEN home ELSE len(list_filter(ends, lambda x: x <= mid)) END::INT AS shard FROM p, e)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY key, sub, doc_id) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM a
"""

OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.seen = e.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(c.seen) AS component_id FROM n JOIN c USING (doc_id) GROUP BY n.doc_id, n.n
"""

OP7 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

OP9 = r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
bs AS (SELECT item_id, len(w) AS n, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END AS sh FROM b WHERE len(w) > 0),
seed AS (SELECT DISTINCT n, unnest(range(len(sh))) AS off, unnest(sh) AS s FROM bs),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
ds AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM d WHERE len(w) > 0),
few AS (SELECT DISTINCT n AS k FROM bs WHERE n < 5),
pr AS (SELECT doc_id, w, i, s FROM ds UNION ALL SELECT doc_id, w, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, few WHERE len(w) > k),
hit AS (SELECT DISTINCT doc_id, w, greatest(1, i - off) AS st, least(i - off + n, len(w) + 1) - greatest(1, i - off) AS n FROM pr JOIN seed USING (s)),
win AS (SELECT doc_id, st, n, w[st:st + n - 1] AS x FROM hit),
tx AS (SELECT DISTINCT x, CASE WHEN len(x) >= 5 THEN list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' ')) ELSE [array_to_string(x, ' ')] END AS sh FROM win),
every AS (SELECT DISTINCT sh FROM (SELECT sh FROM tx UNION ALL SELECT sh FROM bs)),
hash AS (SELECT sh, list_transform(sh, lambda s: ('0x' || substr(md5(s), 1, 8))::BIGINT) AS h1, list_transform(sh, lambda s: ('0x' || substr(md5(s), 9, 8))::BIGINT) AS h2 FROM every),
sim AS (SELECT sh, list_sum(list_transform(range(32), lambda k: CASE WHEN 2 * list_sum(list_transform(h1, lambda v: (v >> k) & 1)) > len(h1) THEN 1::BIGINT << k ELSE 0 END))::BIGINT AS a,
        list_sum(list_transform(range(32), lambda k: CASE WHEN 2 * list_sum(list_transform(h2, lambda v: (v >> k) & 1)) > len(h2) THEN 1::BIGINT << k ELSE 0 END))::BIGINT AS b FROM hash),
near AS (SELECT tx.x, bs.item_id, tx.sh AS p, bs.sh AS q, bit_count(xor(u.a, v.a)) + bit_count(xor(u.b, v.b)) AS hamming FROM tx JOIN sim u ON u.sh = tx.sh, bs JOIN sim v ON v.sh = bs.sh WHERE bit_count(xor(u.a, v.a)) + bit_count(xor(u.b, v.b)) <= 15),
ex AS (SELECT x, item_id, hamming, list_sum(list_transform(list_distinct(list_concat(p, q)), lambda s: least(len(list_filter(p, lambda y: y = s)), len(list_filter(q, lambda y: y = s)))))::DOUBLE
       / list_sum(list_transform(list_distinct(list_concat(p, q)), lambda s: greatest(len(list_filter(p, lambda y: y = s)), len(list_filter(q, lambda y: y = s))))) AS similarity FROM near),
o AS (SELECT doc_id, item_id, st, n, hamming, similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, st, n) AS k FROM win JOIN ex USING (x) WHERE similarity >= 0.8)
SELECT doc_id, item_id, (st - 1)::BIGINT AS start, n::BIGINT AS n_words, hamming::BIGINT AS hamming, similarity FROM o WHERE k = 1
"""

OP10 = rf"""
WITH p AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
q AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) x(verdict, rhost, rpath))
SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, coalesce(arg_max(verdict, length(rhost || rpath)), 'allow') AS verdict
FROM q LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id, host, path
"""



def _op11(rounds: int = 4) -> str:
    """Every part against every entry, round by round."""
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS x FROM v, range(4) r(part)),
b0 AS MATERIALIZED (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1)::BIGINT AS e, x AS c FROM p QUALIFY e < 256)"""
    ]
    near = "n{i} AS MATERIALIZED (SELECT vec_id, label, part, x, min((list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c))::BIGINT * 256 + e) AS m FROM p JOIN b{i} USING (part) GROUP BY ALL)"
    for i in range(rounds):
        steps.append(near.format(i=i))
        steps.append(f"""u{i} AS (SELECT part, e, list(floor(s / n) ORDER BY j) AS c FROM (SELECT part, m % 256 AS e, j, sum(x[j]) AS s, count(*) AS n FROM n{i}, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM p))) AS j) GROUP BY ALL) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(u.c, b.c) AS c FROM b{i} b LEFT JOIN u{i} u USING (part, e))""")
    steps.append(near.format(i=rounds))
    return (
        "WITH " + ",\n".join(steps) + f""",
f AS (SELECT vec_id, label, string_agg(printf('%02x', m % 256), '' ORDER BY part) AS code, sum(m // 256)::BIGINT AS error FROM n{rounds} GROUP BY ALL),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f, h
"""
    )


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; `tab` is the table of OP4."""
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(hex(encode({text}))) // 2), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT)"


OP12 = f"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
i AS (SELECT doc_id, {_crc32("doc_id::VARCHAR")} AS h FROM (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL), t),
x AS (SELECT doc_id, source, h % 17 AS m, (h // 100) % 30000 AS key, CASE WHEN h % 17 > 6 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) THEN ((h // 100) % 30000) || ':' || text END AS said FROM documents JOIN i USING (doc_id)),
b AS (SELECT doc_id, hex(encode(said)) AS g FROM x WHERE said IS NOT NULL),
y AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(g) // 2), lambda k: ('0x' || substr(g, 2 * k + 1, 2))::BIGINT)), lambda c, v: xor(tab[(xor(c, v) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS crc FROM b, t),
w AS (SELECT x.doc_id, m, key, coalesce(crc, -1) AS now, min(CASE WHEN m <= 2 THEN x.doc_id END) OVER later AS ends, min(CASE WHEN m IN (3, 4) THEN x.doc_id END) OVER later AS saves, min(CASE WHEN m IN (5, 6) THEN x.doc_id END) OVER later AS rolls
      FROM x LEFT JOIN y USING (doc_id) WINDOW later AS (PARTITION BY source ORDER BY x.doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
c AS (SELECT w.doc_id, key, now, ends, rolls, CASE WHEN rolls < coalesce(saves, rolls + 1) AND rolls < coalesce(ends, rolls + 1) THEN 'rollback' WHEN f.m <= 1 THEN 'commit' ELSE 'abort' END AS how FROM w LEFT JOIN (SELECT doc_id, m FROM x) f ON f.doc_id = ends WHERE w.m > 6),
k AS (SELECT doc_id AS ends, (row_number() OVER (ORDER BY doc_id) - 1) // 64 + 1 AS epoch FROM x WHERE m <= 1),
a AS (SELECT key, epoch, now FROM c JOIN k USING (ends) WHERE how = 'commit' QUALIFY row_number() OVER (PARTITION BY key, epoch ORDER BY ends DESC, c.doc_id DESC) = 1),
l AS (SELECT epoch, now, coalesce(lag(now) OVER (PARTITION BY key ORDER BY epoch), -1) AS was FROM a),
e AS (SELECT epoch, sum((now >= 0)::INT - (was >= 0)::INT) AS n, sum(greatest(now, 0) - greatest(was, 0)) AS value FROM (SELECT * FROM l UNION ALL SELECT DISTINCT epoch, -1, -1 FROM k) GROUP BY epoch)
SELECT 'state' AS kind, epoch::BIGINT AS id, (sum(n) OVER (ORDER BY epoch))::BIGINT AS n, (sum(value) OVER (ORDER BY epoch))::BIGINT AS value FROM e
UNION ALL SELECT how, doc_id::BIGINT, (CASE WHEN how = 'rollback' THEN rolls ELSE ends END)::BIGINT, key::BIGINT FROM c WHERE how <> 'commit'
"""

OP13 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ORACLE = {"op2_mixing": OP2, "op4_sharding": OP4, "op6_jaccard_join": OP6, "op7_warc": OP7, "op9_decontamination": OP9, "op10_url_filter": OP10, "op11_vector_codes": _op11(), "op12_log_reassembly": OP12, "op13_exact_dedup": OP13}
