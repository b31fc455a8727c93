"""DuckDB SQL that gives the rows of the catalog's queries."""

from __future__ import annotations

from ..functions.hashing import PRIME, coefficients

P = PRIME


def _family(n: int) -> str:
    return "(VALUES " + ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(coefficients(n))) + ") AS f(i, a, b)"


REVIEWS = """reviews AS (
  SELECT l_orderkey AS ord, o_custkey AS "user", l_suppkey AS item, ceil(l_quantity / 10)::BIGINT AS stars, o_orderdate AS date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""
SPLIT = (
    REVIEWS
    + """, train AS (
  SELECT "user", item, floor(sum(stars) / count(*) + 0.5)::BIGINT AS stars FROM reviews WHERE ord % 10 <> 0 GROUP BY ALL
), held AS (
  SELECT "user", item, floor(sum(stars) / count(*) + 0.5)::BIGINT AS stars FROM reviews WHERE ord % 10 = 0 GROUP BY ALL
), test AS (
  SELECT * FROM held UNION ALL SELECT -"user" - 1, item, stars FROM held WHERE item % 50 = 0
  UNION ALL SELECT "user", -item - 1, stars FROM held WHERE item % 50 = 1
  UNION ALL SELECT -"user" - 1, -item - 1, stars FROM held WHERE item % 50 = 2
), ua AS (SELECT "user", sum(stars) / count(*) AS user_avg, count(*) AS n FROM train GROUP BY "user"),
ia AS (SELECT item, sum(stars) / count(*) AS item_avg, count(*) AS n FROM train GROUP BY item),
known AS (SELECT "user", item, user_avg, item_avg FROM (SELECT DISTINCT "user", item FROM test) LEFT JOIN ua USING ("user") LEFT JOIN ia USING (item))"""
)
PEARSON = (
    SPLIT
    + """, sums AS (
  SELECT x.item AS a, y.item AS b, count(*) AS n, sum(x.stars)::BIGINT AS sx, sum(y.stars)::BIGINT AS sy, sum(x.stars * y.stars)::BIGINT AS sxy,
    sum(x.stars * x.stars)::BIGINT AS sxx, sum(y.stars * y.stars)::BIGINT AS syy
  FROM train x JOIN train y ON x."user" = y."user" AND x.item < y.item GROUP BY ALL
), similar_items AS (
  SELECT a, b, sums.n, CASE WHEN sums.n <= 1 THEN least(p.item_avg, q.item_avg) / greatest(p.item_avg, q.item_avg)
    WHEN sums.n * sxy - sx * sy <= 0 OR (sums.n * sxx - sx * sx) * (sums.n * syy - sy * sy) <= 0 THEN 0.0
    ELSE (sums.n * sxy - sx * sy) / sqrt(((sums.n * sxx - sx * sx) * (sums.n * syy - sy * sy))::DOUBLE) END AS similarity
  FROM sums JOIN ia p ON p.item = a JOIN ia q ON q.item = b
)"""
)
TOP3 = (
    PEARSON
    + """, both_ways AS (SELECT a AS item, b AS neighbour, similarity FROM similar_items UNION ALL SELECT b, a, similarity FROM similar_items),
ranked AS (
  SELECT k."user", k.item, neighbour, similarity, t.stars, row_number() OVER (PARTITION BY k."user", k.item ORDER BY similarity DESC, neighbour) AS rank
  FROM known k JOIN train t ON t."user" = k."user" AND t.item <> k.item JOIN both_ways s ON s.item = k.item AND s.neighbour = t.item
  WHERE user_avg IS NOT NULL AND item_avg IS NOT NULL
), top3 AS (SELECT * FROM ranked WHERE rank <= 3)"""
)
CF = (
    TOP3
    + """, w AS (SELECT "user", item, sum(similarity * stars) AS num, sum(similarity) AS den FROM top3 GROUP BY ALL),
cf AS (
  SELECT "user", item, CASE WHEN user_avg IS NULL OR item_avg IS NULL THEN coalesce(user_avg, item_avg, 3.0) WHEN den > 0 THEN num / den ELSE item_avg END AS prediction
  FROM known LEFT JOIN w USING ("user", item)
), errors AS (SELECT abs(prediction - stars) AS error FROM test JOIN cf USING ("user", item))"""
)
BASKETS = "b AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
L1 = BASKETS + ", f1 AS (SELECT item, count(*) AS n FROM b GROUP BY item HAVING count(*) >= 80)"
L2 = (
    L1
    + """, c2 AS (SELECT x.item AS i, y.item AS j FROM f1 x JOIN f1 y ON x.item < y.item),
f2 AS (SELECT x.item AS i, y.item AS j, count(*) AS n FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY ALL HAVING count(*) >= 80)"""
)
L3 = (
    L2
    + """, c3 AS (SELECT x.i, x.j, y.j AS k FROM f2 x JOIN f2 y ON x.i = y.i AND x.j < y.j JOIN f2 z ON z.i = x.j AND z.j = y.j),
f3 AS (SELECT x.item AS i, y.item AS j, z.item AS k, count(*) AS n FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item
  JOIN b z ON z.basket = y.basket AND y.item < z.item GROUP BY ALL HAVING count(*) >= 80)"""
)
TOKENS = r"s AS (SELECT doc_id AS doc, unnest(list_distinct(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'))) AS token FROM documents)"
SIGS = TOKENS + f""", g AS (
  SELECT doc, i, min(((('0x' || substr(md5(token), 1, 8))::BIGINT % {P}) * a + b) % {P}) AS h FROM s, {_family(100)} GROUP BY ALL
)"""
BANDS = SIGS + ", d AS (SELECT doc, i // 4 AS band, string_agg(h::VARCHAR, '-' ORDER BY i) AS key FROM g GROUP BY ALL)"
PAIRS = BANDS + ", p AS (SELECT DISTINCT x.doc AS a, y.doc AS b FROM d x JOIN d y ON x.band = y.band AND x.key = y.key AND x.doc < y.doc)"
STREAM = 'st AS (SELECT o_orderkey AS seq, o_orderkey // 300 AS batch, o_custkey AS "user" FROM orders)'
GRAPH = """pu AS (SELECT DISTINCT o_custkey AS usr, l_partkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT x.usr AS u, y.usr AS v, count(*) AS overlap FROM pu x JOIN pu y ON x.item = y.item AND x.usr < y.usr GROUP BY ALL HAVING count(*) >= 7),
ee AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), vs AS (SELECT DISTINCT u AS vertex FROM ee)"""
PATHS = (
    GRAPH
    + """, lv AS (
  SELECT u AS s, u AS t, 0 AS d FROM ee GROUP BY u UNION SELECT lv.s, ee.v, lv.d + 1 FROM lv JOIN ee ON ee.u = lv.t WHERE lv.d < 40
), dist AS (SELECT s, t, min(d) AS d FROM lv GROUP BY ALL)"""
)
COMPS = GRAPH + ", r AS (SELECT vertex, vertex AS root FROM vs UNION SELECT ee.v, r.root FROM r JOIN ee ON ee.u = r.vertex), cc AS (SELECT vertex, min(root) AS component FROM r GROUP BY vertex)"
POINTS = """pt AS (SELECT vec_id AS idx, label::BIGINT AS label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
cl AS (SELECT label AS cluster, dim, count(*) AS n, sum(x) AS sum, sum(x * x) AS sumsq FROM pt GROUP BY ALL),
cs AS (SELECT *, sum / n AS mean, sqrt(greatest(0.0, sumsq / n - (sum / n) * (sum / n))) AS dev FROM cl)"""
NEAR = (
    POINTS
    + """, md AS (SELECT idx, cluster, sqrt(sum(CASE WHEN dev > 0 THEN ((x - mean) / dev) * ((x - mean) / dev) ELSE 0 END)) AS distance FROM pt JOIN cs USING (dim) GROUP BY ALL),
nr AS (SELECT idx, cluster, distance FROM md QUALIFY row_number() OVER (PARTITION BY idx ORDER BY distance, cluster) = 1)"""
)


def _lpa(rounds: int) -> str:
    out = "WITH " + GRAPH + ", l0 AS (SELECT vertex, vertex AS label FROM vs)"
    for i in range(rounds):
        out += f""", l{i + 1} AS (SELECT u AS vertex, label FROM (SELECT ee.u, label, count(*) AS n FROM ee JOIN l{i} ON l{i}.vertex = ee.v GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC, label) = 1)"""
    return out + f" SELECT vertex, label FROM l{rounds}"


def _paths() -> str:
    return (
        "WITH RECURSIVE "
        + PATHS
        + """, sg(s, t, d, paths) AS (
  SELECT s, t, d, 1.0::DOUBLE FROM dist WHERE d = 0
  UNION ALL
  SELECT q.s, q.v, q.d, q.paths FROM (SELECT sg.s, ee.v, sg.d + 1 AS d, sum(sg.paths) AS paths FROM sg JOIN ee ON ee.u = sg.t JOIN dist ON dist.s = sg.s AND dist.t = ee.v AND dist.d = sg.d + 1 GROUP BY sg.s, ee.v, sg.d) q
)
SELECT least(x.t, y.s) AS u, greatest(x.t, y.s) AS v, round(sum(x.paths * y.paths / z.paths) / 2, 6) AS betweenness
FROM sg x JOIN ee ON ee.u = x.t JOIN sg y ON y.s = ee.v JOIN sg z ON z.s = x.s AND z.t = y.t AND z.d = x.d + 1 + y.d GROUP BY ALL"""
    )


def _fm() -> str:
    return f"""WITH {STREAM}, h AS (
  SELECT batch, i, max(CASE WHEN v = 0 THEN 1 ELSE bit_count((v & -v) - 1) END) AS tz FROM (SELECT batch, i, (("user" % {P}) * a + b) % {P} AS v FROM st, {_family(15)}) GROUP BY ALL
), m AS (SELECT batch, i // 3 AS g, sum(pow(2.0, tz)) / 3 AS mean FROM h GROUP BY ALL)
SELECT batch, truth, floor(est)::BIGINT AS estimate FROM (SELECT batch, median(mean) AS est FROM m GROUP BY batch) JOIN (SELECT batch, count(DISTINCT "user") AS truth FROM st GROUP BY batch) USING (batch)"""


def _bloom(bits: int) -> str:
    return f"""WITH {STREAM}, fi AS (SELECT "user", min(seq) AS seq, arg_min(batch, seq) AS batch FROM st GROUP BY "user"),
h AS (SELECT "user", seq, batch, (("user" % {P}) * a + b) % {P} % {bits} AS bit FROM fi, {_family(5)}),
s AS (SELECT bit, min(seq) AS set_at FROM h GROUP BY bit),
x AS (SELECT "user", batch, min((set_at < seq)::INT) AS fp FROM h JOIN s USING (bit) GROUP BY "user", batch),
y AS (SELECT batch, sum(fp)::BIGINT AS fp, sum(1 - fp)::BIGINT AS tn FROM x GROUP BY batch)
SELECT batch, coalesce(fp, 0) AS fp, coalesce(tn, 0) AS tn, CASE WHEN coalesce(fp + tn, 0) > 0 THEN fp / (fp + tn) ELSE 0.0 END AS fpr
FROM (SELECT DISTINCT batch FROM st) LEFT JOIN y USING (batch)"""


def _reservoir(size: int, slots: list[int]) -> str:
    (a, b), (c, d) = coefficients(2)
    return f"""WITH {STREAM}, q AS (
  SELECT batch, seq, "user", CASE WHEN seq + 1 <= {size} THEN seq ELSE (((seq + 1) % {P}) * {c} + {d}) % {P} % {size} END AS slot FROM st
  WHERE seq + 1 <= {size} OR ((((seq + 1) % {P}) * {a} + {b}) % {P})::HUGEINT * (seq + 1) < {P}::HUGEINT * {size}
), n AS (SELECT batch, max(seq) + 1 AS n FROM st GROUP BY batch), s AS (SELECT unnest({slots}) AS slot)
SELECT n.batch, n.n, s.slot::BIGINT AS slot, (SELECT arg_max("user", seq) FROM q WHERE q.slot = s.slot AND q.seq < n.n) AS "user" FROM n, s"""


MEANS = (
    CF
    + """, mm AS (SELECT "user", item, (coalesce(user_avg, item_avg, 3.0) + coalesce(item_avg, user_avg, 3.0)) / 2 AS m FROM known)"""
)

SQL = {
    "review_counts": f'WITH {REVIEWS} SELECT count(*) AS n_review, count(*) FILTER (year(date) = 1998) AS n_review_year, count(DISTINCT "user") AS n_user, count(DISTINCT item) AS n_item FROM reviews',
    "reviews_in_year": f"WITH {REVIEWS} SELECT count(*) AS n FROM reviews WHERE year(date) = 1998",
    "distinct_users": f'WITH {REVIEWS} SELECT count(DISTINCT "user") AS n FROM reviews',
    "distinct_items": f"WITH {REVIEWS} SELECT count(DISTINCT item) AS n FROM reviews",
    "top10_users": f'WITH {REVIEWS} SELECT "user", count(*) AS n FROM reviews GROUP BY "user" ORDER BY n DESC, "user" LIMIT 10',
    "top10_items": f"WITH {REVIEWS} SELECT item, count(*) AS n FROM reviews GROUP BY item ORDER BY n DESC, item LIMIT 10",
    "city_avg_stars": f"WITH {REVIEWS} SELECT n_name AS city, round(sum(stars) / count(*), 6) AS stars FROM reviews JOIN supplier ON item = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "city_top10": f"WITH {REVIEWS}, c AS (SELECT n_name AS city, sum(stars) / count(*) AS stars FROM reviews JOIN supplier ON item = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name) SELECT city, round(stars, 6) AS stars FROM (SELECT * FROM c ORDER BY stars DESC, city LIMIT 10)",
    "partition_report": f"WITH {REVIEWS} SELECT item % 10 AS chunk, count(*) AS n_items FROM reviews GROUP BY ALL",
    "json_props": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "csv_file": """SELECT lpad(s_suppkey::VARCHAR, 9, '0') AS id, 'a "quoted", name of ' || s_name AS name, s_nationkey AS nation FROM supplier""",
    "json_file": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "text_file": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word",
    "transactions_file": "SELECT strftime(o_orderdate, '%-m/%-d/%y') || '-' || o_custkey AS tx, count(DISTINCT l_partkey) AS n_items FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "points_file": f"WITH {POINTS} SELECT idx, any_value(label) AS cluster, count(*) AS dims, round(sum(x), 4) AS total FROM pt GROUP BY idx",
    "key_partitions": f"WITH {REVIEWS} SELECT item, count(*) AS n_items, 1::BIGINT AS partitions FROM reviews GROUP BY item",
    "folded_names": f"SELECT c_custkey, list_reduce(list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 256 + c) % {P}) AS h FROM customer",
    "dense_ids": "SELECT row_number() OVER (ORDER BY c_name) - 1 AS id, c_name FROM (SELECT DISTINCT c_name FROM customer)",
    "tx_baskets": "SELECT strftime(o_orderdate, '%-m/%-d/%y') || '-' || o_custkey AS tx, count(DISTINCT l_partkey) AS n_items FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "basket_case1": f"WITH {BASKETS} SELECT basket, string_agg(item, ',' ORDER BY item) AS items FROM b GROUP BY basket",
    "basket_case2": f"WITH {BASKETS} SELECT item AS basket, count(*) AS n_items, min(basket) AS first, max(basket) AS last FROM b GROUP BY item",
    "basket_filtered": f"WITH {BASKETS} SELECT basket, string_agg(item, ',' ORDER BY item) AS items FROM b GROUP BY basket HAVING count(*) > 3",
    "son_candidates_1": f"WITH {BASKETS} SELECT DISTINCT item FROM (SELECT basket % 10 AS chunk, item FROM b GROUP BY ALL HAVING count(*) >= 8)",
    "freq_1": f"WITH {L1} SELECT item AS items, n FROM f1",
    "cand_2": f"WITH {L2} SELECT i || ',' || j AS items FROM c2",
    "freq_2": f"WITH {L2} SELECT i || ',' || j AS items, n FROM f2",
    "cand_3": f"WITH {L3} SELECT i || ',' || j || ',' || k AS items FROM c3",
    "freq_3": f"WITH {L3} SELECT i || ',' || j || ',' || k AS items, n FROM f3",
    "minhash_signatures": f"WITH {SIGS} SELECT doc, i AS hash_no, h AS minhash FROM g",
    "lsh_bands": f"WITH {BANDS} SELECT doc, band, key FROM d",
    "lsh_candidates": f"WITH {PAIRS} SELECT a, b FROM p",
    "similar_pairs": f"""WITH {PAIRS}, z AS (SELECT doc, count(*) AS n FROM s GROUP BY doc), o AS (
  SELECT p.a, p.b, count(*) AS x FROM p JOIN s x ON x.doc = p.a JOIN s y ON y.doc = p.b AND x.token = y.token GROUP BY ALL)
SELECT a, b, round(x / (za.n + zb.n - x), 6) AS similarity FROM o JOIN z za ON za.doc = a JOIN z zb ON zb.doc = b WHERE x / (za.n + zb.n - x) >= 0.5""",
    "user_avg": f'WITH {SPLIT} SELECT "user", round(user_avg, 6) AS avg_stars, n FROM ua',
    "item_avg": f"WITH {SPLIT} SELECT item, round(item_avg, 6) AS avg_stars, n FROM ia",
    "cold_start": f'WITH {SPLIT} SELECT "user", item, round(coalesce(user_avg, item_avg, 3.0), 6) AS prediction FROM known WHERE user_avg IS NULL OR item_avg IS NULL',
    "pearson_pairs": f"WITH {PEARSON} SELECT a, b, n, round(similarity, 6) AS similarity FROM similar_items",
    "top3_neighbours": f'WITH {TOP3} SELECT "user", item, neighbour, round(similarity, 6) AS similarity, stars FROM top3',
    "cf_predictions": f'WITH {CF} SELECT "user", item, round(prediction, 6) AS prediction FROM cf',
    "user_features": f'WITH {SPLIT} SELECT "user", n AS user_count, round(user_avg, 6) AS user_stars FROM ua',
    "item_features": f"WITH {SPLIT} SELECT item, n AS item_count, round(item_avg, 6) AS item_stars, floor(s_acctbal / 2500)::BIGINT AS price_range FROM ia JOIN supplier ON s_suppkey = item",
    "feature_matrix": f"""WITH {SPLIT}, im AS (SELECT item, n, item_avg, floor(s_acctbal / 2500)::BIGINT AS price FROM ia JOIN supplier ON s_suppkey = item),
m AS (SELECT (SELECT avg(n) FROM ua) AS uc, (SELECT sum(user_avg) / count(*) FROM ua) AS us, (SELECT avg(n) FROM im) AS ic, (SELECT sum(item_avg) / count(*) FROM im) AS si)
SELECT test."user", test.item, stars, round(coalesce(ua.n, uc)::DOUBLE, 6) AS user_count, round(coalesce(user_avg, us), 6) AS user_stars, round(coalesce(im.n, ic)::DOUBLE, 6) AS item_count,
  round(coalesce(item_avg, si), 6) AS item_stars, coalesce(price, 0) AS price_range FROM test LEFT JOIN ua USING ("user") LEFT JOIN im ON im.item = test.item, m""",
    "means_blend": f'WITH {MEANS} SELECT "user", item, round(0.1::DOUBLE * prediction + 0.9::DOUBLE * m, 6) AS prediction FROM cf JOIN mm USING ("user", item)',
    "support_blend": f"""WITH {MEANS}, nn AS (SELECT "user", item, count(*) AS near FROM top3 GROUP BY ALL)
SELECT "user", item, round(CASE WHEN coalesce(near, 0) + coalesce(ln(1 + ia.n), 0) > 0
  THEN (coalesce(near, 0) * prediction + coalesce(ln(1 + ia.n), 0) * m) / (coalesce(near, 0) + coalesce(ln(1 + ia.n), 0)) ELSE m END, 6) AS prediction
FROM cf JOIN mm USING ("user", item) LEFT JOIN nn USING ("user", item) LEFT JOIN ia USING (item)""",
    "rmse": f"WITH {CF} SELECT round(sqrt(avg(error * error)), 6) AS rmse FROM errors",
    "error_histogram": f"WITH {CF} SELECT least(floor(error)::BIGINT, 4) AS level, count(*) AS n FROM errors GROUP BY ALL",
    "bloom_fpr": _bloom(9973),
    "fm_estimate": _fm(),
    "exact_distinct": f'WITH {STREAM} SELECT batch, count(DISTINCT "user") AS truth FROM st GROUP BY batch',
    "reservoir_sample": _reservoir(100, [0, 20, 40, 60, 80]),
    "reservoir_table": "SELECT n AS seqnum, " + ", ".join(f'max("user") FILTER (slot = {i}) AS "{i}_id"' for i in [0, 20, 40, 60, 80]) + f" FROM ({_reservoir(100, [0, 20, 40, 60, 80])}) GROUP BY batch, n",
    "window_distinct": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS n_user FROM events GROUP BY ALL",
    "graph_edges": f"WITH {GRAPH} SELECT u, v, overlap FROM e",
    "graph_vertices": f"WITH {GRAPH} SELECT vertex FROM vs",
    "connected_components": f"WITH RECURSIVE {COMPS} SELECT vertex, component FROM cc",
    "label_propagation": _lpa(5),
    "communities": f"WITH RECURSIVE {COMPS} SELECT count(*) AS size, string_agg(vertex::VARCHAR, ',' ORDER BY vertex) AS members FROM cc GROUP BY component",
    "community_lines": f"WITH RECURSIVE {COMPS} SELECT chr(39) || string_agg(vertex::VARCHAR, chr(39) || ', ' || chr(39) ORDER BY vertex) || chr(39) AS value FROM cc GROUP BY component",
    "edge_betweenness": _paths(),
    "modularity": f"""WITH RECURSIVE {COMPS}, k AS (SELECT u AS vertex, count(*) AS k FROM ee GROUP BY u), m AS (SELECT count(*) AS m FROM e),
w AS (SELECT count(*) AS within FROM e JOIN cc a ON a.vertex = u JOIN cc b ON b.vertex = v WHERE a.component = b.component),
q AS (SELECT sum(x.k * y.k) AS kk FROM k x JOIN cc a ON a.vertex = x.vertex JOIN cc b ON b.component = a.component AND b.vertex > a.vertex JOIN k y ON y.vertex = b.vertex)
SELECT round((within - kk / (2 * m)) / (2 * m), 6) AS modularity FROM w, m, q""",
    "cluster_summary": f"WITH {POINTS} SELECT cluster, dim, n, round(sum, 4) AS sum, round(sumsq, 4) AS sumsq, round(mean, 4) AS mean, round(dev, 4) AS dev FROM cs",
    "point_mahalanobis": f"WITH {NEAR} SELECT idx, cluster, round(distance, 4) AS distance FROM nr",
    "cluster_mahalanobis": f"""WITH {POINTS} SELECT a.cluster AS a, b.cluster AS b, round((sqrt(sum(CASE WHEN b.dev > 0 THEN ((a.mean - b.mean) / b.dev) ** 2 ELSE 0 END))
  + sqrt(sum(CASE WHEN a.dev > 0 THEN ((a.mean - b.mean) / a.dev) ** 2 ELSE 0 END))) / 2, 4) AS distance FROM cs a JOIN cs b ON a.dim = b.dim AND a.cluster < b.cluster GROUP BY ALL""",
    "ds_cs_rs_assign": f"""WITH {NEAR}, d AS (SELECT * FROM md WHERE cluster < 5 QUALIFY row_number() OVER (PARTITION BY idx ORDER BY distance, cluster) = 1),
c AS (SELECT * FROM md WHERE cluster >= 5 QUALIFY row_number() OVER (PARTITION BY idx ORDER BY distance, cluster) = 1)
SELECT vec_id AS idx, CASE WHEN d.distance < sqrt(64) THEN 'DS' WHEN c.distance < sqrt(64) THEN 'CS' ELSE 'RS' END AS kind,
  CASE WHEN d.distance < sqrt(64) THEN d.cluster WHEN c.distance < sqrt(64) THEN c.cluster ELSE -1 END AS cluster FROM embeddings LEFT JOIN d ON d.idx = vec_id LEFT JOIN c ON c.idx = vec_id""",
}
