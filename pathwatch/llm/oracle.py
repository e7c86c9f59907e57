"""SQL of another engine that must give the same rows as queries of this subpackage."""

from __future__ import annotations

from .license_scan import BASE_PHRASES, COVERED, NEIGHBOURS, NOTICES, STRETCH, K

SUBSTRING_DEDUP = r"""
WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
k AS (SELECT doc_id, word, i, CASE WHEN count(*) OVER f = 50 THEN string_agg(word, ' ') OVER f END AS key FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
first AS (SELECT key, min(doc_id) AS lo FROM k WHERE key IS NOT NULL GROUP BY key),
hit AS (SELECT k.doc_id, k.word, k.i, coalesce(first.lo < k.doc_id, false) AS cut FROM k LEFT JOIN first ON k.key = first.key),
gone AS (SELECT doc_id, word, i, bool_or(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM hit),
per AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id
"""

SHARDING = """
WITH r AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS h FROM documents),
l AS (SELECT r.*, CAST(d.d AS INTEGER) AS depth, h >> (60 - d.d) AS prefix FROM r CROSS JOIN range(61) d(d)),
s AS (SELECT *, count(*) OVER p AS shard_rows, CAST(sum(n_bytes) OVER p AS BIGINT) AS shard_bytes FROM l WINDOW p AS (PARTITION BY depth, prefix)),
f AS (SELECT * FROM s WHERE shard_bytes <= 1048576 OR depth = 60 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN 'all' ELSE lpad(CAST(bin(prefix) AS VARCHAR), depth, '0') END AS shard, depth, shard_rows, shard_bytes FROM f
"""

_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TEMPLATES = ", ".join(f"({i}, '{label}', {str(base).lower()}, '{text}')" for i, (label, base, text) in enumerate([(a, True, b) for a, b in BASE_PHRASES] + [(a, False, b) for a, b in NOTICES]))

LICENSE_SCAN = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o) AS gram FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT t, label, base, len(w) AS t_words, w FROM (SELECT t, label, base, {_WORDS.format('text')} AS w FROM (VALUES {_TEMPLATES}) v(t, label, base, text))),
tg AS (SELECT t, label, base, t_words, i - 1 AS t_pos, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS gram FROM (SELECT *, unnest(range(1, t_words - {K} + 2)) AS i FROM t)),
v AS (SELECT DISTINCT doc_id, t, label, base, t_words, pos - t_pos AS diagonal, pos, t_pos FROM g JOIN tg ON g.gram = tg.gram),
n AS (SELECT doc_id, t, label, base, t_words, diagonal, min(pos) AS first, max(pos) AS last, list(t_pos) AS at_ FROM v GROUP BY ALL),
b AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list(DISTINCT label) AS base_labels FROM n WHERE base AND len(at_) = t_words - {K} + 1 GROUP BY doc_id),
x AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) <= {NEIGHBOURS} THEN 0 ELSE 1 END AS new FROM n WHERE NOT base),
y AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS span FROM x),
z AS (SELECT doc_id, t, label, t_words, span, min(first) AS first, max(last) AS last, list_distinct(flatten(list(at_))) AS at_ FROM y GROUP BY doc_id, t, label, t_words, span),
c AS (SELECT *, len(list_distinct(flatten([range(p, p + {K}) FOR p IN at_]))) / t_words AS covered FROM z),
m AS (SELECT doc_id, list(DISTINCT label) AS labels, max(covered) AS covered FROM c WHERE covered >= {COVERED} AND last + {K} - first <= {STRETCH} * t_words GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word,
  array_to_string(list_sort(coalesce(b.base_labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.base_labels, []), coalesce(m.labels, [])))), ',') AS labels,
  CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(m.covered, 0.0) END AS score
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""

#: crc32 of distinct texts: `crc` (s, h), from `crc_in` (s); bytes come from the text's hexadecimal form, the table from its rule.
_CRC = """
crc_table AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
crc AS (SELECT s, xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(s)), lambda k: CAST(concat('0x', hex(encode(s))[2 * k + 1:2 * k + 2]) AS BIGINT))), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM crc_in CROSS JOIN crc_table)
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Near words come from equal rests: a word without its i-th letter is another word, or another word without that letter.
SPELLING_VARIANTS = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
crc_in AS (SELECT DISTINCT concat(doc_id, ':', run) AS s FROM runs),
{_CRC},
typed AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, c FROM runs JOIN crc ON s = concat(doc_id, ':', run)),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
rests AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM rests a JOIN rests b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT r.word, v.word, v.n FROM rests r JOIN v ON r.rest = v.word
  UNION SELECT v.word, r.word, r.n FROM rests r JOIN v ON r.rest = v.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word),
tops AS (SELECT near.word, min(near.near) AS near FROM near JOIN best ON near.word = best.word AND near_n = top GROUP BY near.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN near END AS form, CASE WHEN top >= 10 * v.n THEN top END AS form_n FROM v LEFT JOIN best ON v.word = best.word LEFT JOIN tops ON v.word = tops.word),
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON chain.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN chain ON f.word = chain.word JOIN (SELECT word FROM f WHERE form IS NULL) e ON root = e.word
"""

IMPORTANCE_RESAMPLING = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w, row_number() OVER () AS r FROM documents),
sw AS (SELECT r, unnest(w) AS s FROM d), tw AS (SELECT unnest({_WORDS.format('text')}) AS s FROM benchmark),
crc_in AS (SELECT DISTINCT s FROM (SELECT s FROM sw UNION ALL SELECT s FROM tw)),
{_CRC},
b AS (SELECT s, h % 10000 AS bucket FROM crc),
sc AS (SELECT bucket, count(*) AS s FROM sw JOIN b ON sw.s = b.s GROUP BY bucket), tc AS (SELECT bucket, count(*) AS t FROM tw JOIN b ON tw.s = b.s GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM sw) + 10000)::DOUBLE / ((coalesce(sc.s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM tw) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM sc FULL JOIN tc USING (bucket)),
x AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM sw JOIN b ON sw.s = b.s JOIN g ON b.bucket = g.bucket GROUP BY r),
z AS (SELECT doc_id, r, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST(concat('0x', substr(sha256(concat('2024:', doc_id)), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN x USING (r)),
p AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM z),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM p WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM p LEFT JOIN k USING (r)
"""
