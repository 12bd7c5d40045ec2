"""DuckDB forms of the operators that SQL can express, straight from their definitions: every window, every pair of texts that share a shingle, every slot."""

#: Of op1: all 100-byte windows as hexadecimal text, those that stand anywhere before, their union, and what is left between. doc_ids are unique.
OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS p FROM d WHERE length(h) >= 200)),
again AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, p) > 1),
edges AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100, true)::INT AS first FROM again),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM edges) GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS c FROM cuts),
kept AS (SELECT doc_id, sha256(unhex(string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a, b))) AS kept_sha256, sum(b - a) AS n_removed, count(*) - 1 AS n_spans FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, kept_sha256 FROM d JOIN kept USING (doc_id)
"""

#: Of op2: texts of one shingle set are one class; classes that share a shingle are compared on full sets; reachability by recursion over classes.
OP2_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS shingles FROM t
), k AS (SELECT doc_id, len(shingles) AS n, md5(array_to_string(shingles, chr(10))) AS class, shingles FROM s),
c AS (SELECT class, n, any_value(shingles) AS shingles, min(doc_id) AS low FROM k WHERE n > 0 GROUP BY class, n),
e AS (SELECT class, n, low, unnest(shingles) AS x FROM c),
links AS (
  SELECT a.low AS u, b.low AS v FROM e a JOIN e b ON a.x = b.x AND a.low <> b.low GROUP BY a.low, b.low, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (SELECT low AS u, low AS v FROM c UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
m AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, k.n AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM k LEFT JOIN c USING (class, n) LEFT JOIN m ON u = low
"""

#: Of op10: with equal weights block i of one of m sources is released at i * m and due at (i + 1) * m, slots of its phase; the released block that is due
#: first goes next, of equals that of the first source. One slot for each step; a phase ends with the last block of a source. doc_ids are unique.
OP10_SQL = """
WITH RECURSIVE s AS (SELECT source, row_number() OVER (ORDER BY source NULLS LAST) AS j, (count(*) + 63) // 64 AS blocks FROM documents GROUP BY source),
steps AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS phase, CAST(0 AS BIGINT) AS start, list(blocks ORDER BY j) AS remaining, list(CAST(0 AS BIGINT) ORDER BY j) AS done, list(blocks ORDER BY j) AS blocks,
         CAST(NULL AS BIGINT) AS j, CAST(NULL AS BIGINT) AS block, CAST(NULL AS BIGINT) AS released, CAST(NULL AS BIGINT) AS due FROM s
  UNION ALL
  SELECT slot + 1, CASE WHEN ends THEN phase + 1 ELSE phase END, CASE WHEN ends THEN slot + 2 ELSE start END, list_transform(remaining, lambda x, i: CASE WHEN i = pick THEN x - 1 ELSE x END),
         list_transform(done, lambda x, i: CASE WHEN ends THEN 0 WHEN i = pick THEN x + 1 ELSE x END), blocks, pick, blocks[pick] - remaining[pick], start + done[pick] * m, start + (done[pick] + 1) * m
  FROM (SELECT *, remaining[pick] = 1 AS ends FROM (SELECT *, list_min(list_transform(alive, lambda i: done[i] * 1000000 + i)) % 1000000 AS pick, len(alive) AS m FROM (SELECT *, list_filter(range(1, len(remaining) + 1), lambda i: remaining[i] > 0) AS alive FROM steps) WHERE len(alive) > 0))
), placed AS (SELECT s.source, block, slot, released, due, phase - CASE WHEN block = s.blocks - 1 THEN 1 ELSE 0 END AS phase FROM steps JOIN s USING (j)),
n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)
SELECT doc_id, n.source, block AS mix_block, phase AS mix_phase, slot AS mix_slot, released AS mix_release, due AS mix_deadline, slot * 64 + n % 64 AS mix_place
FROM n JOIN placed ON n.source IS NOT DISTINCT FROM placed.source AND n.n // 64 = block
"""

#: Of op12: all windows of 20 words by the digest of their words, those that stand anywhere before, their union, and the words left. doc_ids are unique.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, p, md5_number(array_to_string(w[p + 1:p + 20], ' ')) AS m FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS p FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, p FROM s QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, p + i AS i FROM again, range(20) AS r(i)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: Of op13: every anchor against every row, its positives, and every row of another label within the window of each.
OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS anchor_id, v.vec_id, q.label = v.label AS same, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
fits AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank FROM fits)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
