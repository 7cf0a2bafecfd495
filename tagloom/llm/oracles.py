"""SQL for the pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

from tagloom.plans.evidence_queries import LK as _LK, NORM as _NORM, WS as _WS

_BASKETS = f"""{_LK}, items AS (
  SELECT DISTINCT 'record' AS basket_kind, key AS b, idx AS i FROM (SELECT key, trim(unnest(pn_positive), {_WS}) AS t FROM evidence) JOIN lk USING (t)
  UNION SELECT DISTINCT 'batch', CAST(global_batch AS VARCHAR), balanced_label_index FROM sample_reference WHERE balanced_label_index IN (SELECT idx FROM label_dim)),
 n AS (SELECT basket_kind, count(DISTINCT b) AS n FROM items GROUP BY 1), c AS (SELECT basket_kind, i, count(*) AS c FROM items GROUP BY 1, 2),
 p AS (SELECT x.basket_kind, x.i AS label_a, y.i AS label_b, count(*) AS n_ab FROM items x JOIN items y ON x.basket_kind = y.basket_kind AND x.b = y.b AND x.i < y.i GROUP BY 1, 2, 3),
 t AS (SELECT p.*, a.c AS n_a, b.c AS n_b, n.n AS n_baskets FROM p JOIN c a ON a.basket_kind = p.basket_kind AND a.i = label_a JOIN c b ON b.basket_kind = p.basket_kind AND b.i = label_b JOIN n ON n.basket_kind = p.basket_kind)"""

_SLOTS = f"""s AS (SELECT DISTINCT global_batch, slot, lower(trim(stream, {_WS})) AS stream, balanced_label_index AS i FROM sample_reference),
 z AS (SELECT count(DISTINCT (global_batch, slot)) // 10 AS size FROM s),
 r AS (SELECT t.category_id, any_value(t.target_ppm) AS ppm, any_value(t.min_rows) AS least, count(s.slot) AS rows FROM sample_target t LEFT JOIN s ON s.stream = lower(trim(t.stream, {_WS})) AND s.i IS NOT DISTINCT FROM t.balanced_label_index GROUP BY 1)"""

_OVERLAPS = f"""{_NORM}, k AS (SELECT DISTINCT key, sha, path, ph, CAST('0x' || substr(ph, 1, 8) AS BIGINT) AS h, CAST('0x' || substr(ph, 9, 8) AS BIGINT) AS l, lower(trim(split, {_WS})) AS s FROM norm),
 t AS (SELECT * FROM k WHERE s = 'train'), e AS (SELECT * FROM k WHERE s IN ('val', 'test')),
 p AS (SELECT e.key, 'sha256' AS how, t.key AS other FROM t JOIN e ON t.sha = e.sha UNION SELECT e.key, 'image_path', t.key FROM t JOIN e ON t.path = e.path UNION SELECT e.key, 'phash64', t.key FROM t JOIN e ON bit_count(xor(t.h, e.h)) + bit_count(xor(t.l, e.l)) <= 2)"""

SQL = {
    "p6_report": f"""WITH {_OVERLAPS}, h AS (SELECT key, max((how = 'sha256')::INT) AS x, max((how = 'phash64')::INT) AS y, max((how = 'image_path')::INT) AS z FROM p GROUP BY 1),
 q AS (SELECT DISTINCT key, source, lower(trim(split, {_WS})) AS split FROM evidence WHERE key IS NOT NULL)
 SELECT split, source, count(*) AS n_keys, count(x) AS n_overlapping, coalesce(sum(x), 0)::BIGINT AS n_sha256, coalesce(sum(y), 0)::BIGINT AS n_phash64, coalesce(sum(z), 0)::BIGINT AS n_image_path FROM q LEFT JOIN h USING (key) WHERE split IN ('val', 'test') GROUP BY 1, 2""",
    "p5_groups": f"""WITH RECURSIVE {_NORM}, k AS (SELECT DISTINCT key, ph FROM norm WHERE key IS NOT NULL), e AS (
  SELECT key_a AS a, key_b AS b FROM match_pair WHERE lower(trim(verdict, {_WS})) = 'match' AND key_a IN (SELECT key FROM k) AND key_b IN (SELECT key FROM k)
  UNION SELECT min(key) OVER (PARTITION BY ph), key FROM k WHERE ph IS NOT NULL),
 e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT key AS v, key AS w FROM k UNION SELECT r.v, e2.b FROM r JOIN e2 ON r.w = e2.a)
 SELECT v AS key, min(w) AS group_key FROM r GROUP BY 1""",
    "p1_found": f"WITH {_BASKETS} SELECT basket_kind, label_a, label_b FROM t WHERE n_ab >= 5 AND n_ab * n_baskets >= 3 * n_a * n_b",
    "p1_pairs": f"""WITH {_BASKETS}, d AS (SELECT *, n_ab::DOUBLE AS x, (n_a - n_ab)::DOUBLE AS y, (n_b - n_ab)::DOUBLE AS z, (n_baskets - n_a - n_b + n_ab)::DOUBLE AS w FROM t)
 SELECT basket_kind, label_a, label_b, n_ab, n_a, n_b, n_baskets, round(x * n_baskets / (n_a::DOUBLE * n_b), 9) AS lift, round(((x + 0.5) * (w + 0.5)) / ((y + 0.5) * (z + 0.5)), 9) AS odds_ratio FROM d""",
    "p2_found": f"WITH {_SLOTS} SELECT category_id FROM r, z WHERE rows * 1000000 < ppm::BIGINT * size OR rows < least",
    "p2_checks": f"""WITH {_SLOTS} SELECT least(any_value(z.size), sum(rows))::BIGINT AS sample_rows, sum(rows)::BIGINT AS supply, 0 AS twice, 0 AS "over", 0 AS small, count(*) FILTER (rows * 1000000 < ppm::BIGINT * size) AS below_share, count(*) FILTER (rows < least) AS below_min FROM r, z""",
    "p4_survivors": f"""WITH {_NORM}, k AS (SELECT DISTINCT key, sha, (source IS NOT NULL)::INT + (rec IS NOT NULL)::INT + (path IS NOT NULL)::INT + (ph IS NOT NULL)::INT AS n, rec, path, ph, coalesce(trust_rank, 2147483647) AS t, captured_at FROM norm LEFT JOIN evidence_source USING (source) WHERE sha IS NOT NULL),
 f AS (SELECT sha, key, row_number() OVER (PARTITION BY sha ORDER BY n DESC, t, captured_at DESC NULLS LAST, key) AS o FROM k), g AS (SELECT sha, count(DISTINCT key) > 1 AS several, bool_or(rec IS NOT NULL) AS has_record_id, bool_or(path IS NOT NULL) AS has_image_path, bool_or(ph IS NOT NULL) AS has_phash64 FROM k GROUP BY 1)
 SELECT sha AS sha256, key, several, has_record_id, has_image_path, has_phash64 FROM f JOIN g USING (sha) WHERE o = 1""",
    "p4_found": f"""WITH {_NORM}, k AS (SELECT DISTINCT key, sha, (source IS NOT NULL)::INT AS a, (rec IS NOT NULL)::INT AS b, (path IS NOT NULL)::INT AS c, (ph IS NOT NULL)::INT AS d, coalesce(trust_rank, 2147483647) AS t, captured_at FROM norm LEFT JOIN evidence_source USING (source) WHERE sha IS NOT NULL)
 SELECT x.sha AS sha256, x.key FROM k x WHERE EXISTS (SELECT 1 FROM k y WHERE y.sha = x.sha AND y.key <> x.key)
  AND NOT EXISTS (SELECT 1 FROM k y WHERE y.sha = x.sha AND y.key <> x.key AND NOT (x.a >= y.a AND x.b >= y.b AND x.c >= y.c AND x.d >= y.d AND x.t <= y.t AND x.captured_at >= y.captured_at
   AND (x.a > y.a OR x.b > y.b OR x.c > y.c OR x.d > y.d OR x.t < y.t OR x.captured_at > y.captured_at)))""",
    "p5_found": f"""WITH RECURSIVE {_NORM}, k AS (SELECT DISTINCT key, ph FROM norm), e AS (
  SELECT key_a AS a, key_b AS b FROM match_pair WHERE lower(trim(verdict, {_WS})) = 'match' AND key_a IN (SELECT key FROM k) AND key_b IN (SELECT key FROM k)
  UNION SELECT min(key) OVER (PARTITION BY ph), key FROM k WHERE ph IS NOT NULL),
 e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT key AS v, key AS w FROM k UNION SELECT r.v, e2.b FROM r JOIN e2 ON r.w = e2.a)
 SELECT v AS key, min(w) AS group_key FROM r GROUP BY 1 HAVING count(*) > 1""",
    "p6_found": f"""WITH {_NORM}, k AS (SELECT DISTINCT key, sha, path, CAST('0x' || substr(ph, 1, 8) AS BIGINT) AS h, CAST('0x' || substr(ph, 9, 8) AS BIGINT) AS l, lower(trim(split, {_WS})) AS s FROM norm),
 t AS (SELECT * FROM k WHERE s = 'train'), e AS (SELECT * FROM k WHERE s IN ('val', 'test')),
 p AS (SELECT t.key AS a, e.key AS b FROM t JOIN e ON t.sha = e.sha UNION SELECT t.key, e.key FROM t JOIN e ON t.path = e.path UNION SELECT t.key, e.key FROM t JOIN e ON bit_count(xor(t.h, e.h)) + bit_count(xor(t.l, e.l)) <= 2)
 SELECT DISTINCT least(a, b) AS key_a, greatest(a, b) AS key_b FROM p""",
    "p7_found": f"WITH {_NORM}, k AS (SELECT DISTINCT key, rec FROM norm WHERE rec IS NOT NULL) SELECT key, min(key) OVER (PARTITION BY rec) AS entity_key FROM k QUALIFY count(*) OVER (PARTITION BY rec) > 1",
}
