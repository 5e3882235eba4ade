"""DuckDB SQL for the queries that SQL can express."""

OP8 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id)
"""

ORACLES = {"op8_exact_dedup": OP8}

OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT doc_id, 0 AS no, text, regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS a,
    regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v,
    string_split_regex(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS g FROM d
  UNION ALL SELECT doc_id, 1, text, regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 2, text, regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0), string_split_regex(text, '[0-9a-f]+') FROM d
  UNION ALL SELECT doc_id, 3, text, regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0), regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0), string_split_regex(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') FROM d
  UNION ALL SELECT doc_id, 4, text, regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0), regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0), string_split_regex(text, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}') FROM d),
x AS (SELECT doc_id, no, unnest(generate_series(1, len(a))) AS i, a, v, g FROM m WHERE len(a) > 0),
y AS (SELECT doc_id, no, i, length(g[i]) AS gap, length(a[i]) AS n, length(v[i]) AS vn FROM x),
z AS (SELECT doc_id, no, n, vn, CAST(sum(gap + n) OVER (PARTITION BY doc_id, no ORDER BY i) AS BIGINT) AS e FROM y),
s AS (SELECT doc_id, no, e - n AS b, e, ['assign', 'access', 'hex', 'pem', 'jwt'][no + 1] || ':' || (e - n) || ':' || e AS t
      FROM z WHERE vn >= [12, 18, 16, 1, 1][no + 1])
SELECT d.doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
  sha256(coalesce(string_agg(t, ',' ORDER BY b, no) FILTER (no < 3), '')) AS base_sha256, coalesce(string_agg(t, ',' ORDER BY b, no), '') AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""
ORACLES["op9_secret_scan"] = OP9

ORACLES["op1_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

ORACLES["op5_chat_format"] = """
WITH c AS (
  SELECT conv_id, count(*) AS n_turns, list(coalesce(role, '') || chr(1) || coalesce(text, '') ORDER BY turn) AS t,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn) AS rendered
  FROM conversations GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS copies, t, min(rendered) AS rendered FROM c GROUP BY t, n_turns),
p AS (SELECT DISTINCT list_slice(t, 1, i) AS t FROM (SELECT t, unnest(generate_series(1, n_turns - 1)) AS i FROM u))
SELECT conv_id, n_turns, copies, rendered FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.t = u.t)
"""

ORACLES["op2_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS source FROM g) WHERE source < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT x.doc_id, count(gone.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.p) FILTER (gone.p IS NULL), '') AS kept FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

ORACLES["op6_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""

ORACLES["op10_html_text"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(?:p|h1)>|<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c
"""

ORACLES["op4_source_mix"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM s),
r AS (SELECT *, row_number() OVER w AS pos, coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_, sum(source_size) OVER () AS total
      FROM n WINDOW w AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, number)),
l AS (SELECT *, CAST(total - full_ AS DOUBLE) / CAST(left_ AS DOUBLE) AS level FROM r),
f AS (SELECT coalesce(arg_min(level, pos) FILTER (level <= CAST(3 * source_size AS DOUBLE) / weight), 0) AS fill FROM l),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * fill) AS target, CAST(round(least(CAST(3 * source_size AS DOUBLE), weight * fill)) AS BIGINT) AS goal FROM l, f),
o AS (SELECT doc_id, size, source_size, target, goal, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE goal // source_size * size + greatest(0, least(size, goal % source_size - start)) END AS BIGINT) AS taken
FROM o
"""


def _crc_row(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ 0xEDB88320 if i & 1 else i >> 1
    return i


_CRC_ROWS = f"[{', '.join(str(_crc_row(i)) for i in range(256))}]::UBIGINT[]"


def _crc(text: str) -> str:
    """CRC-32 of a string in UTF-8, which DuckDB has no function for."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS UBIGINT))"
    return f"CAST(xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || {data}, lambda a, b: xor(({_CRC_ROWS})[CAST((xor(a, b) & 255) AS INTEGER) + 1], a >> 8))) AS BIGINT)"


def _clock(name: str) -> str:
    return f"-ln((CAST(CAST('0x' || substr(md5({name} || ':' || k), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0) / w"


def _tree(shards: int) -> str:
    """The tree of a number of shards (8 a region, 4 a rack, the first 16 opened at once), and each id's way down."""
    t = f"t{shards}"
    return f"""{t} AS (SELECT n, n // 8 AS region, n // 4 % 2 AS rack, greatest(0, n - 15) AS o FROM range({shards}) r(n)),
{t}a AS (SELECT region || '@' || o AS name, count(*) AS w FROM {t} GROUP BY ALL),
{t}b AS (SELECT region || '@' || o AS parent, region || '.' || rack || '@' || o AS name, count(*) AS w FROM {t} GROUP BY ALL),
{t}c AS (SELECT region || '.' || rack || '@' || o AS parent, region || '.' || rack || '.' || n || '@' || o AS name, 1 AS w, n FROM {t}),
{t}x AS (SELECT k, arg_min(name, {_clock("name")}) AS region FROM ids, {t}a GROUP BY k),
{t}y AS (SELECT k, arg_min(name, {_clock("name")}) AS rack FROM {t}x JOIN {t}b ON parent = region GROUP BY k),
{t}z AS (SELECT k, CAST(arg_min(n, {_clock("name")}) AS INTEGER) AS shard FROM {t}y JOIN {t}c ON parent = rack GROUP BY k)"""


ORACLES["op11_sharding"] = f"""
WITH d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_crc("coalesce(text, '')")} AS text_crc32 FROM documents),
ids AS (SELECT DISTINCT k FROM d),
{_tree(16)},
{_tree(17)},
h AS (SELECT *, CAST('0x' || substr(md5(k || ':' || text_crc32), 1, 15) AS BIGINT) AS h FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, a.shard, row_number() OVER (PARTITION BY a.shard ORDER BY h, doc_id, size, text_crc32) - 1 AS slot, b.shard AS grown_shard
FROM h JOIN t16z a USING (k) JOIN t17z b USING (k)
"""

ORACLES["op12_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi FROM u),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(list_slice(u, 1, lo), '') AS p, array_to_string(list_slice(u, lo + 1, hi), '') AS m, array_to_string(list_slice(u, hi + 1, n), '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM f
"""

ORACLES["op13_spelling_variants"] = rf"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS i, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
h AS (SELECT run, length(run) AS l, {_crc("i || ':' || run")} AS h FROM r WHERE length(run) >= 7),
o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % l) || substr(run, h % l + 2) ELSE run END AS word FROM h),
w AS (SELECT word, count(*) AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word UNION SELECT a.word, b.word FROM x a JOIN w b ON a.less = b.word UNION SELECT b.word, a.word FROM x a JOIN w b ON a.less = b.word),
g AS (SELECT p.a, count(*) AS n_near, max(b.n) AS top, arg_min(p.b, (-b.n, p.b)) AS best FROM p JOIN w b ON b.word = p.b GROUP BY p.a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN best END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n FROM w LEFT JOIN g ON g.a = word),
t(word, root, further) AS (SELECT word, word, form FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.further)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word AND t.further IS NULL
"""
