"""SQL that gives the same rows as the queries of this subpackage, where SQL can."""

OP3 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p
), b AS (
  SELECT *, list_reduce(list_transform(range(0, 40), lambda i:
    ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
      [strpos('0123456789abcdef', substr(digest, (i + 1)::INT, 1))]), lambda x, y: x || y) AS bits FROM f
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1
    + 16 * substr(bits, (5 * i + 1)::INT, 1)::INT + 8 * substr(bits, (5 * i + 2)::INT, 1)::INT
    + 4 * substr(bits, (5 * i + 3)::INT, 1)::INT + 2 * substr(bits, (5 * i + 4)::INT, 1)::INT
    + substr(bits, (5 * i + 5)::INT, 1)::INT)::INT, 1)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER g AS keep_id, first_value(n_chars) OVER g AS keep_chars,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW g AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND n_chars = keep_chars AS kept,
  sha256(norm) AS text_sha256
FROM w
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h FROM documents
), r AS (
  SELECT source, s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source)
), f AS (
  SELECT *, (sum(s) OVER () - 3 * coalesce(sum(s) OVER b, 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE * w > (3 * s)::DOUBLE AS stops
  FROM r WINDOW b AS (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, s, CASE WHEN stops THEN (3 * s)::DOUBLE ELSE
    (sum(s - CASE WHEN stops THEN 3 * s ELSE 0 END) OVER ())::DOUBLE
      / (sum(CASE WHEN stops THEN 0 ELSE w END) OVER ())::DOUBLE * w END AS target FROM f
), c AS (
  SELECT d.*, t.s, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, row_number() OVER () AS row
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT row, size, sum(size) OVER (ORDER BY (pass * s + cum)::DOUBLE / target, h,
    CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END, pass, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM c, (SELECT unnest(range(3)) AS pass)
  WHERE size > 0 AND (pass * s + cum - size)::DOUBLE < target
), k AS (
  SELECT row, sum(size)::BIGINT AS taken FROM q WHERE run <= (SELECT sum(size) FROM d) GROUP BY row
)
SELECT doc_id, size, s AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM c LEFT JOIN k USING (row)
"""

OP10 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    coalesce(min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id, false) AS e FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), b AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * e::INT AS bits
  FROM d LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY part, bits
), f AS (
  SELECT i, chr(65 + i) AS letter, 1 << i AS bit FROM (SELECT unnest(range(5))::INT AS i)
), o AS (
  SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order FROM f p, f q, f r, f s, f t
  WHERE (p.bit | q.bit | r.bit | s.bit | t.bit) = 31
), k AS (
  SELECT filter_order, step, (SELECT bit FROM f WHERE letter = substr(filter_order, step, 1)) AS bit,
    coalesce((SELECT sum(bit) FROM f WHERE contains(substr(filter_order, 1, step - 1), letter)), 0)::INT AS mask
  FROM o, (SELECT unnest(range(1, 6))::INT AS step)
), r AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN bits & (mask | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN bits & bit > 0 AND bits & mask = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN bits & bit > 0 AND bits & mask > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN bits = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN bits & bit > 0 AND bits & mask = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN bits & bit > 0 AND bits & mask = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, k GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM r
"""

OP12 = r"""
WITH RECURSIVE c AS (
  SELECT *, doc_id::VARCHAR AS d, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS crc
  FROM documents
), f AS (
  SELECT *, coalesce(strlen(d) || ':' || d, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, CASE WHEN doc_id IS NOT NULL AND crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM c
), g AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS now_leaf FROM f
), v AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER () AS id FROM g
), t AS (
  SELECT source, 0 AS lv, pos, n, leaf AS h FROM v
  UNION ALL
  SELECT source, lv + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY source, lv, pos // 3, n
), r AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS top FROM t WHERE n = 1
), u AS (
  SELECT 0 AS lv, top AS pos, count(*) OVER () AS n, subroot AS h FROM r
  UNION ALL
  SELECT lv + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lv, pos // 3, n
), s AS (
  SELECT source, lv, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM t WHERE n > 1 WINDOW w AS (PARTITION BY source, lv, pos // 3 ORDER BY pos)
), a AS (
  SELECT lv, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM u WHERE n > 1 WINDOW w AS (PARTITION BY lv, pos // 3 ORDER BY pos)
), p AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY lv) AS k, l, r FROM (
    SELECT v.id, s.lv, s.l, s.r FROM v JOIN s ON v.source IS NOT DISTINCT FROM s.source AND s.pos = v.pos // pow(3, s.lv)::BIGINT
    UNION ALL
    SELECT v.id, 1000 + a.lv, a.l, a.r FROM v JOIN r ON v.source IS NOT DISTINCT FROM r.source JOIN a ON a.pos = r.top // pow(3, a.lv)::BIGINT)
), q AS (
  SELECT id, 0::BIGINT AS k, now_leaf AS h FROM v
  UNION ALL
  SELECT id, p.k, sha256(p.l || q.h || p.r) FROM q JOIN p USING (id) WHERE p.k = q.k + 1
), z AS (
  SELECT id, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM p GROUP BY id
), y AS (
  SELECT id, arg_max(h, k) AS folded_root FROM q GROUP BY id
), w AS (
  SELECT v.doc_id, v.leaf, r.subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root
  FROM v JOIN r ON v.source IS NOT DISTINCT FROM r.source JOIN y USING (id) LEFT JOIN z USING (id)
)
SELECT *, folded_root = root AS verified FROM w
"""

OP13 = r"""
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS i, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), k AS (
  SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.i, b.i AS j FROM k a JOIN k b ON a.label = b.label AND a.i <> b.i
  WHERE list_cosine_similarity(list_resize(a.v, greatest(len(a.v), len(b.v)), 0), list_resize(b.v, greatest(len(a.v), len(b.v)), 0)) >= 0.98
), r AS (
  SELECT i, i AS j FROM e UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i
), c AS (
  SELECT r.i, min(e.vec_id) AS component_id FROM r JOIN e ON r.j = e.i GROUP BY r.i
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e JOIN c USING (i) LEFT JOIN (SELECT i, count(*) AS n FROM l GROUP BY i) USING (i)
"""

ORACLE_SQL: dict[str, str] = {
    "op3_warc_round_trip": OP3,
    "op5_exact_dedup": OP5,
    "op9_source_mixing": OP9,
    "op10_exact_topk": OP10,
    "op11_filter_audit": OP11,
    "op12_merkle_manifest": OP12,
    "op13_embedding_near_dedup": OP13,
}
