"""DuckDB SQL of the queries that SQL can express."""

#: CRC-32 by half bytes; the table has the CRCs of the numbers 0 to 15.
CRC_TABLE = []
for _i in range(16):
    for _ in range(4):
        _i = _i >> 1 ^ 0xEDB88320 * (_i & 1)
    CRC_TABLE.append(_i)

OP1 = f"""
WITH nibbles AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\\2\\1', 'g') AS hx FROM documents),
crcs AS (SELECT doc_id, octet_length(encode(t))::BIGINT + 16 AS size, xor(4294967295,
    list_reduce(list_transform(string_split(hx, ''), lambda c: CASE WHEN c = '' THEN -1 ELSE (instr('0123456789ABCDEF', c) - 1) END::BIGINT),
        lambda a, n: CASE WHEN n < 0 THEN a ELSE xor(a >> 4, {CRC_TABLE}[(xor(a, n) & 15) + 1]::BIGINT) END, 4294967295::BIGINT)) AS text_crc32 FROM nibbles),
sums AS (SELECT *, sum(size) OVER o - size AS b, row_number() OVER o - 1 AS i, sum(size) OVER () AS total FROM crcs
    WINDOW o AS (ORDER BY text_crc32, doc_id ROWS UNBOUNDED PRECEDING)),
rows1 AS (SELECT *, least(39, ((2 * b + size) * 40) // (2 * total))::INT AS s1, min(b) OVER g AS gb, sum(size) OVER g AS gs FROM sums WINDOW g AS (PARTITION BY text_crc32)),
rows2 AS (SELECT *, CASE WHEN gs * 4000 <= total THEN least(39, ((2 * gb + gs) * 40) // (2 * total))::INT ELSE s1 END AS s2, min(s1) OVER g AS lo, max(s1) OVER g AS hi FROM rows1 WINDOW g AS (PARTITION BY text_crc32)),
rows3 AS (SELECT *, CASE WHEN lo < hi THEN s2 ELSE s1 END AS shard FROM rows2)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (i - min(i) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM rows3
"""

OP4 = r"""
WITH lines AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)),
firsts AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id > f.first, false) AS gone FROM lines l LEFT JOIN firsts f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP8 = r"""
WITH urls AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS v
    FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, u.host, u.path, rule, coalesce(v, 'allow') AS verdict FROM urls u LEFT JOIN best b ON u.host = b.host AND u.path = b.path
"""

#: The walk starts at slot (step 0) and goes on while it is outside 0..n-1.
OP2 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS sz, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS code FROM d GROUP BY source),
weighed AS (SELECT *, CASE code % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, (SELECT sum(sz) FROM src) AS total FROM src),
sorted AS (SELECT *, coalesce(sum(3 * sz) OVER p, 0) AS pc, coalesce(sum(w) OVER p, 0) AS pw, (SELECT sum(w) FROM weighed) AS ws FROM weighed
    WINDOW p AS (ORDER BY sz::DOUBLE / w, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, bool_and(w * (total - pc) > 3 * sz * (ws - pw)) OVER (ORDER BY sz::DOUBLE / w, code ROWS UNBOUNDED PRECEDING) AS full_ FROM sorted),
target AS (SELECT source, code, sz, CASE WHEN full_ THEN (3 * sz)::DOUBLE ELSE (w * (total - (SELECT coalesce(sum(3 * sz) FILTER (full_), 0) FROM capped)))::DOUBLE / (SELECT sum(w) FILTER (NOT full_) FROM capped) END AS target FROM capped),
plan AS (SELECT *, (sz + 127) // 128 AS n, CASE WHEN sz = 0 THEN 0 ELSE floor(target / sz)::BIGINT END AS passes FROM target),
plan2 AS (SELECT *, least(n, floor((target - passes * sz) / 128 + 0.5)::BIGINT) AS rest, greatest(1, ceil(log2(greatest(2, n)) / 2))::BIGINT AS h FROM plan),
walk(code, n, h, m, k, slot, x, step) AS (
    SELECT code, n, h, (1::BIGINT << h) - 1, (20 * 7919 + code * 104729 + passes * 1299709) % 2147483648, unnest(range(rest)) AS slot, NULL::BIGINT, 0 FROM plan2
    UNION ALL
    SELECT code, n, h, m, k, slot, (l << h) | r, step + 1 FROM (SELECT code, n, h, m, k, slot, step, l, r FROM (WALK)))
, drawn AS (SELECT code, x AS block FROM walk WHERE x < n),
rows_ AS (SELECT d.doc_id, d.size, d.source, p.code, p.sz, p.target, p.passes, (sum(d.size) OVER (PARTITION BY p.code ORDER BY d.doc_id ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS b, row_number() OVER () AS rn
    FROM d JOIN plan2 p ON d.source IS NOT DISTINCT FROM p.source),
parts AS (SELECT rn, code, b, size, unnest(range(b // 128, (b + size - 1) // 128 + 1)) AS block FROM rows_ WHERE size > 0),
part AS (SELECT rn, sum(least(block * 128 + 128 - b, size) - greatest(block * 128 - b, 0)) AS got FROM parts JOIN drawn USING (code, block) GROUP BY rn)
SELECT doc_id, size, sz AS source_size, target, (passes * size + coalesce(got, 0))::BIGINT AS taken FROM rows_ LEFT JOIN part USING (rn)
"""


def _walk() -> str:
    sql = "SELECT code, n, h, m, k, slot, step, coalesce(x, slot) >> h AS l, coalesce(x, slot) & m AS r FROM walk WHERE x IS NULL OR x >= n"
    for i in range(4):
        sql = f"SELECT code, n, h, m, k, slot, step, r AS l, xor(l, (((r + k + {i * 15485863}) % 2147483648 * 1103515245 % 2147483648) >> 11) & m) AS r FROM ({sql})"
    return sql


OP2 = OP2.replace("(WALK)", f"({_walk()})")

def _lloyd(k: int) -> str:
    """Assignment to codebook k, and the codebook that follows it."""
    far = " + ".join(f"(q.{c} - b.{c}) * (q.{c} - b.{c})" for c in "uvwx")
    moved = ", ".join(f"coalesce(floor(sum(q.{c})::DOUBLE / count(q.rn)), any_value(b.{c}))::BIGINT AS {c}" for c in "uvwx")
    return f"""
near{k} AS (SELECT rn, q.p, min(({far}) * 64 + e) AS f FROM cut q JOIN book{k} b ON q.p = b.p GROUP BY rn, q.p),
book{k + 1} AS (SELECT b.p, b.e, {moved} FROM book{k} b LEFT JOIN (SELECT c.*, f % 64 AS e FROM cut c JOIN near{k} USING (rn, p)) q ON b.p = q.p AND b.e = q.e GROUP BY b.p, b.e)"""


OP13 = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id, embedding) AS rn FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT rn, p, v[4 * p + 1] AS u, v[4 * p + 2] AS v, v[4 * p + 3] AS w, v[4 * p + 4] AS x FROM kept, range(16) t(p)),
book0 AS (SELECT p, rn - 1 AS e, u, v, w, x FROM cut WHERE rn <= 64),{_lloyd(0)},{_lloyd(1)},{_lloyd(2)},
coded AS (SELECT rn, string_agg(printf('%02x', f % 64), '' ORDER BY p) AS code, sum(f // 64)::BIGINT AS error FROM near2 GROUP BY rn)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(concat_ws(',', u, v, w, x), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256 FROM coded JOIN kept USING (rn)
"""

#: Revenue of every (nation, item) after every arrival day, by running sums over a grid of days.
OP12 = f"""
WITH keyed AS (SELECT *, concat(coalesce(sale_id::VARCHAR, ''), ',', coalesce(item_id::VARCHAR, ''), ',', coalesce(vendor_id::VARCHAR, ''), ',', coalesce(line_no::VARCHAR, '')) AS t FROM sale_lines),
crcs AS (SELECT * EXCLUDE t, xor(4294967295, list_reduce(list_transform(string_split(regexp_replace(hex(encode(t)), '(.)(.)', '\\2\\1', 'g'), ''), lambda c: (instr('0123456789ABCDEF', c) - 1)::BIGINT),
    lambda a, n: xor(a >> 4, {CRC_TABLE}[(xor(a, n) & 15) + 1]::BIGINT), 4294967295::BIGINT)) AS h FROM keyed),
dated AS (SELECT *, coalesce(date_diff('day', DATE '1970-01-01', shipped_at::DATE), 19723 + h % 150)::BIGINT AS s FROM crcs),
arrived AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM dated),
batched AS (SELECT *, least(8, 1 + floor((a - 19723) * 8 / 180.0))::INT AS batch FROM arrived),
horizon AS (SELECT batch, max(m) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT batch, max(s) AS m FROM batched GROUP BY batch)),
added AS (SELECT nation_id, item_id, a, any_value(batch) AS batch, sum(CASE WHEN flag = 'swapped' THEN -c ELSE c END) AS c
    FROM (SELECT v.nation_id, b.item_id, b.a, b.batch, b.flag, coalesce(floor(100 * amount + 0.5), quantity * floor(100 * i.price + 0.5), 0) AS c
        FROM batched b JOIN horizon USING (batch) JOIN vendors v USING (vendor_id) JOIN items i ON i.item_id = b.item_id
        WHERE v.nation_id IS NOT NULL AND (top IS NULL OR s + 15 >= top)) GROUP BY ALL),
days AS (SELECT a, any_value(batch) AS batch, row_number() OVER (ORDER BY a) AS n FROM added GROUP BY a),
pairs AS (SELECT nation_id, item_id, min(a) AS first FROM added GROUP BY ALL),
run AS (SELECT p.nation_id, p.item_id, d.n, sum(coalesce(c, 0)) OVER (PARTITION BY p.nation_id, p.item_id ORDER BY d.n ROWS UNBOUNDED PRECEDING) AS revenue
    FROM pairs p JOIN days d ON d.a >= p.first LEFT JOIN added x ON x.nation_id = p.nation_id AND x.item_id = p.item_id AND x.a = d.a),
board AS (SELECT nation_id, item_id, n, row_number() OVER (PARTITION BY nation_id, n ORDER BY revenue DESC, item_id) AS r FROM run WHERE revenue > 0 QUALIFY r <= 10),
diff AS (SELECT coalesce(x.nation_id, o.nation_id) AS nation_id, coalesce(x.item_id, o.item_id) AS item_id, coalesce(x.n, o.n + 1) AS n, o.r AS old_rank, x.r AS new_rank
    FROM board x FULL JOIN board o ON x.nation_id = o.nation_id AND x.item_id = o.item_id AND x.n = o.n + 1)
SELECT nation_id, a AS arrival_day, item_id, batch, CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change, old_rank::INT AS old_rank, new_rank::INT AS new_rank, revenue::BIGINT AS revenue
FROM diff JOIN days USING (n) JOIN run USING (nation_id, item_id, n) WHERE old_rank IS DISTINCT FROM new_rank
"""

#: Pairs meet by shared shingles; components by spreading the smallest id along links until nothing changes.
OP11 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS s FROM w),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
edge AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(x, y) AS (SELECT x, y FROM edge UNION SELECT r.x, b.y FROM reach r JOIN edge b ON r.y = b.x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sets LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON doc_id = x
"""

ORACLES: dict[str, str] = {"op1_sharding": OP1, "op2_mixing": OP2, "op4_line_dedup": OP4, "op8_url_filter": OP8, "op11_jaccard_join": OP11, "op12_leaderboard": OP12, "op13_vector_codes": OP13}
