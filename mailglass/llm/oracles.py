"""The same queries in DuckDB's SQL, for the operators that SQL can express on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIX = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src, source_size * 2.0::DOUBLE AS cap FROM sums),
levels AS (SELECT *, [5, 2, 1][src % 3 + 1] AS weight FROM weighed),
filled AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
    sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS every FROM levels),
aims AS (
  SELECT source, src, source_size, least(cap, weight * max((every * 1.5::DOUBLE - full_) / rest) OVER ()) AS target,
    CAST(pow(2, ceil(log2(least(greatest(source_size / 65536, 1), 65536)))) AS BIGINT) AS blocks FROM filled),
docs AS (
  SELECT d.doc_id, d.size, d.h, a.src, a.source_size, a.target, ((h % blocks) * 5 + 3) % blocks AS block
  FROM sized d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source),
blocks AS (SELECT src, block, any_value(source_size) AS source_size, any_value(target) AS target, sum(size) AS words FROM docs GROUP BY 1, 2 HAVING sum(size) > 0),
placed AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY src ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blocks),
draws AS (SELECT src, block, words, turn, target - before - turn * source_size AS room FROM placed, (VALUES (0), (1)) t(turn) WHERE target - before - turn * source_size > 0),
parts AS (SELECT w.src, w.block, w.turn, w.room, d.h, sum(d.size) AS size FROM draws w JOIN docs d USING (src, block) WHERE w.room < w.words GROUP BY ALL),
upto AS (SELECT *, sum(size) OVER (PARTITION BY src, block, turn ORDER BY h) AS upto FROM parts),
cuts AS (SELECT src, block, turn, max(h) AS h_cut FROM upto WHERE upto - size / 2 <= room GROUP BY ALL),
times AS (
  SELECT d.src, d.block, d.h, count(*) FILTER (WHERE w.room >= w.words OR d.h <= c.h_cut) AS n
  FROM (SELECT DISTINCT src, block, h FROM docs) d JOIN draws w USING (src, block) LEFT JOIN cuts c USING (src, block, turn) GROUP BY ALL)
SELECT d.doc_id, d.size, d.source_size, d.target, d.size * coalesce(t.n, 0) AS taken FROM docs d LEFT JOIN times t USING (src, block, h)
"""

JACCARD = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT node, min(other) AS m FROM reach GROUP BY 1) r ON r.node = d.doc_id
"""

FILL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
placed AS (
  SELECT doc_id, text, u, len(u) AS n, list_transform([1, 9], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT) % (len(u) + 1)) AS ab,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM drawn),
formed AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:list_min(ab)], '') AS prefix, array_to_string(u[list_min(ab) + 1:list_max(ab)], '') AS middle, array_to_string(u[list_max(ab) + 1:], '') AS suffix FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM formed
"""

RESAMPLE = rf"""
WITH crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
aim_words AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
each_word AS (SELECT doc_id, unnest(w) AS w FROM doc_words),
doc_counts AS (SELECT doc_id, w, count(*) AS n FROM each_word GROUP BY 1, 2),
known AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM doc_counts UNION SELECT w FROM aim_words)),
coded AS (
  SELECT w, xor(list_reduce([4294967295] || list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) % 10000 AS bucket FROM known, crc_table),
s AS (SELECT bucket, sum(n) AS n FROM doc_counts JOIN coded USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM aim_words JOIN coded USING (w) GROUP BY 1),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
    / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT doc_id, sum(n * gain) AS total FROM doc_counts JOIN coded USING (w) JOIN gains USING (bucket) GROUP BY 1),
scored AS (
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_features, CAST(coalesce(floor(total::DOUBLE / len(d.w)), 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM doc_words d LEFT JOIN sums USING (doc_id)),
final AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS fit FROM final WHERE n_features >= 20)
SELECT f.doc_id, n_features, weight, score, CASE WHEN place <= 10 * fit // 100 THEN place END AS rank FROM final f LEFT JOIN placed USING (doc_id)
"""

SQL = {"op4_mix_sources": MIX, "op10_jaccard_join": JACCARD, "op11_piece_table": FILL, "op13_importance_resampling": RESAMPLE}
