"""The registered queries in SQL, for a second engine on the same tables."""

from __future__ import annotations

SEED = 7
PTS = "pts AS (SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda e: e::DOUBLE) AS x, label FROM embeddings)"
CUST = "cust AS (SELECT c_custkey::BIGINT AS id, [c_acctbal / 1000.0::DOUBLE, c_nationkey::DOUBLE] AS x, c_acctbal + 1000.0::DOUBLE AS w FROM customer)"
#: Rounding as the queries have it: minus zero becomes zero.
R6 = "round({}, 6) + 0.0::DOUBLE"


def r6(expression: str) -> str:
    return R6.format(expression)


def sample(source: str, rho: float, name: str = "smp", by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return (
        f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER ({part} ORDER BY md5('{SEED}|' || id), id) AS rn, count(*) OVER ({part}) AS n FROM {source}) "
        f"WHERE rn <= greatest(1, floor(n * {rho}::DOUBLE)))"
    )


def centroid(source: str, name: str = "cen", by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"{name} AS (SELECT {keys}list(v ORDER BY dim) AS c FROM (SELECT {keys}dim, avg(v) AS v FROM (SELECT {keys}unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM {source}) GROUP BY {keys}dim) {group})"


def fold(points: str, radius: str, factor: float = 0.1, alpha: float = 1.0) -> str:
    """CTEs f, last and obs(g, oid, o, population, radius): the fold over points(g, i, x) with radius(g, r0)."""
    f = f"{factor}::DOUBLE"
    near = "list_transform(f.s, lambda e: list_distance(e.o, p.x))"
    moved = f"list_transform(list_zip(e.o, x), lambda z: z[1] + {alpha}::DOUBLE * (z[2] - z[1]) / (e.p + 1))"
    return f"""
f AS (
  SELECT p.g, p.i, [{{'o': p.x, 'p': 1::BIGINT, 'r': q.r0}}] AS s FROM {points} p JOIN {radius} q ON p.g = q.g WHERE p.i = 0
  UNION ALL
  SELECT g, i + 1, CASE WHEN d <= s[j].r
    THEN list_transform(s, lambda e, k: CASE WHEN k = j THEN {{'o': {moved}, 'p': e.p + 1, 'r': greatest(0.0::DOUBLE, e.r - {f} * d)}} ELSE e END)
    ELSE list_append(list_transform(s, lambda e, k: CASE WHEN k = j THEN {{'o': e.o, 'p': e.p, 'r': greatest(0.0::DOUBLE, e.r + {f} * d)}} ELSE e END), {{'o': x, 'p': 1::BIGINT, 'r': r0}})
  END
  FROM (SELECT g, i, s, x, r0, list_min(ds) AS d, list_position(ds, list_min(ds)) AS j FROM (
    SELECT f.g, f.i, f.s, p.x, q.r0, {near} AS ds FROM f JOIN {points} p ON p.g = f.g AND p.i = f.i + 1 JOIN {radius} q ON q.g = f.g))
),
last AS (SELECT g, s FROM f QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1),
loc AS (SELECT g, k - 1 AS l, s[k].o AS o, s[k].p AS population, s[k].r AS radius FROM (SELECT g, s, unnest(generate_series(1, len(s))) AS k FROM last)),
obs AS (SELECT g, row_number() OVER (ORDER BY g, l) - 1 AS oid, l, o, population, radius FROM loc)"""


DIGEST = "oid::BIGINT AS oid, population::BIGINT AS population, round(radius, 9) + 0.0::DOUBLE AS radius, round(o[1], 9) + 0.0::DOUBLE AS first, round(list_sum(o), 9) + 0.0::DOUBLE AS total"
GROUPED = DIGEST.replace("oid::BIGINT", "l::BIGINT", 1)
ORDERED = "fp AS (SELECT 0 AS g, row_number() OVER (ORDER BY id) - 1 AS i, id, x FROM pts)"
FIXED = "rad AS (SELECT DISTINCT g, 0.95::DOUBLE AS r0 FROM fp)"


def fit(extra: str = ORDERED, radius: str = FIXED, source: str = PTS, **more: float) -> str:
    return f"WITH RECURSIVE {source}, {extra}, {radius}, {fold('fp', 'rad', **more)}"


#: 500 rows in chunks of 120: four batches of 125; in general the longer ones come first.
BATCHED = """fp AS (SELECT b AS g, row_number() OVER (PARTITION BY b ORDER BY id) - 1 AS i, id, x FROM (
  SELECT id, x, CASE WHEN seq < r * (q + 1) THEN seq // (q + 1) ELSE r + (seq - r * (q + 1)) // q END AS b FROM (
    SELECT id, x, seq, n // greatest(1, n // 120) AS q, n % greatest(1, n // 120) AS r FROM (SELECT id, x, row_number() OVER (ORDER BY id) - 1 AS seq, count(*) OVER () AS n FROM pts))))"""


def knn(points: str, refs: str, k: int, name: str = "nn", d: str = "list_distance(p.x, o.o)") -> str:
    """name(id, oid, d, k)."""
    return f"{name} AS (SELECT * FROM (SELECT p.id, o.oid, {d} AS d, row_number() OVER (PARTITION BY p.id ORDER BY {d}, o.oid) AS k FROM {points} p, {refs} o) WHERE k <= {k})"


MODES = {"median": "median(d)", "mean": "avg(d)", "max": "max(d)", "min": "min(d)", "sum": "sum(d)"}


def uniform(j: str) -> str:
    return f"(('0x' || substr(md5('{SEED}|u|' || ({j})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def drawn(source: str, size: int) -> str:
    """dr(draw, id, x, p) from source(id, x, p)."""
    return f"""cum AS (SELECT id, x, p, coalesce(sum(p) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, lead(id) OVER (ORDER BY id) AS nx FROM {source}),
place AS (SELECT id, x, p, lo, CASE WHEN nx IS NULL THEN 'inf'::DOUBLE ELSE lo + p END AS hi FROM cum),
us AS (SELECT j AS draw, {uniform('j')} AS u FROM (SELECT unnest(range({size})) AS j)),
dr AS (SELECT draw, id, x, p FROM us JOIN place ON u >= lo AND u < hi)"""


def lightweight(source: str) -> str:
    """lw(id, x, p) from source(id, x, w)."""
    return f"""mu AS (SELECT list(v ORDER BY dim) AS m FROM (SELECT dim, sum(w * v) / sum(w) AS v FROM (SELECT w, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM {source}) GROUP BY dim)),
qs AS (SELECT id, x, w, w * list_sum(list_transform(list_zip(x, m), lambda z: (w * z[1] - z[2]) * (w * z[1] - z[2]))) AS q FROM {source}, mu),
raw AS (SELECT id, x, CASE WHEN sum(q) OVER () > 0 THEN 0.5 * q / sum(q) OVER () + 0.5 / sum(w) OVER () ELSE 1 / sum(w) OVER () END AS raw FROM qs),
lw AS (SELECT id, x, raw / sum(raw) OVER () AS p FROM raw)"""


SDO_DRAWN = f"{PTS}, eq AS (SELECT id, x, 1.0::DOUBLE / count(*) OVER () AS p FROM pts), {drawn('eq', 60)}, ob AS (SELECT draw AS oid, x AS o FROM dr)"
SDO_COUNTS = f"{SDO_DRAWN}, {knn('pts', 'ob', 6)}, cnt AS (SELECT ob.oid, any_value(o) AS o, count(nn.id) AS n FROM ob LEFT JOIN nn ON nn.oid = ob.oid GROUP BY ob.oid)"
SDO_ACTIVE = f"{SDO_COUNTS}, act AS (SELECT oid, o, n FROM cnt WHERE n >= (SELECT quantile_cont(n, 0.3) FROM cnt))"
METRIC = {
    "cityblock": "list_sum(list_transform(list_zip(p.x, o.o), lambda z: abs(z[1] - z[2])))",
    "chebyshev": "list_max(list_transform(list_zip(p.x, o.o), lambda z: abs(z[1] - z[2])))",
    "minkowski": "pow(list_sum(list_transform(list_zip(p.x, o.o), lambda z: pow(abs(z[1] - z[2]), 3.0::DOUBLE))), 1.0::DOUBLE / 3)",
}

RANKED = f"{PTS}, {sample('pts', 0.2)}, refs AS (SELECT id AS oid, x AS o FROM smp), {knn('pts', 'refs', 5)}, sc AS (SELECT p.id, {r6('max(d)')} AS score, (any_value(p.label) = 0)::INT AS y FROM nn JOIN pts p ON p.id = nn.id GROUP BY p.id)"
SPLIT = f"{PTS}, sp AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}|' || id), id) <= floor(count(*) OVER (PARTITION BY label) * 0.3::DOUBLE + 0.5) AS is_test FROM pts), te AS (SELECT * FROM sp WHERE is_test), tr AS (SELECT id AS oid, x AS o, label FROM sp WHERE NOT is_test)"


def classified(k: int) -> str:
    return f"{SPLIT}, {knn('te', 'tr', k)}, votes AS (SELECT nn.id, tr.label, count(*) AS n FROM nn JOIN tr ON tr.oid = nn.oid GROUP BY nn.id, tr.label), best AS (SELECT id, label AS predicted FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1), cl AS (SELECT te.id, te.label AS y, predicted FROM te JOIN best ON best.id = te.id)"


def confusion_scores(source: str) -> str:
    return f"""lab AS (SELECT y AS l FROM {source} UNION SELECT predicted FROM {source}),
per AS (SELECT l, (SELECT count(*) FROM {source} WHERE y = l) AS t, (SELECT count(*) FROM {source} WHERE predicted = l) AS g, (SELECT count(*) FROM {source} WHERE y = l AND predicted = l) AS h FROM lab)
SELECT {r6('sum(h) / sum(t)')} AS accuracy, {r6('sum(h) / sum(t)')} AS micro_precision, {r6('avg(CASE WHEN g > 0 THEN h / g ELSE 0 END)')} AS macro_precision, {r6('sum(h) / sum(t)')} AS micro_recall, {r6('avg(CASE WHEN t > 0 THEN h / t ELSE 0 END)')} AS macro_recall FROM per"""


CENTRES = f"{PTS}, {sample('pts', 0.02)}, c0 AS (SELECT id AS oid, x AS o FROM smp), {knn('pts', 'c0', 1, 'n1')}, mem AS (SELECT n1.oid AS oid, pts.x AS x FROM n1 JOIN pts ON pts.id = n1.id), {centroid('mem', 'mean', 'oid')}, c1 AS (SELECT c0.oid, coalesce(mean.c, c0.o) AS o FROM c0 LEFT JOIN mean ON mean.oid = c0.oid)"
LABELLED = f"{CENTRES}, lc AS (SELECT oid, o, label FROM (SELECT c1.oid, c1.o, p.label, row_number() OVER (PARTITION BY c1.oid ORDER BY list_distance(p.x, c1.o), p.id) AS k FROM c1, pts p) WHERE k = 1)"
EXTENDED = f"{LABELLED}, {knn('pts', 'lc', 1)}, ex AS (SELECT p.id, p.label, lc.label AS predicted FROM nn JOIN pts p ON p.id = nn.id JOIN lc ON lc.oid = nn.oid)"
RESULTS = "res AS (SELECT year(o_orderdate)::VARCHAR AS dataset, o_orderstatus AS algorithm, o_orderpriority AS rate, avg(o_totalprice) AS mean_price, max(o_totalprice) AS max_price, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), lng AS (SELECT dataset, algorithm, rate, 'mean_price' AS metric, mean_price AS value FROM res UNION ALL SELECT dataset, algorithm, rate, 'max_price', max_price FROM res UNION ALL SELECT dataset, algorithm, rate, 'n', n FROM res)"

def seeds(source: str, k: int) -> str:
    """seeds(oid, o): k-means++ seeds of source(id, x, w), each the winner of an exponential race."""
    race = "(('0x' || substr(md5('{0}|u|seed{1}|' || id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE + pow(2.0::DOUBLE, -53))"
    out = [f"s0 AS (SELECT 0::BIGINT AS oid, x AS o FROM {source} WHERE w > 0 ORDER BY -ln({race.format(SEED, 0)}) / w, id LIMIT 1)"]
    for i in range(1, k):
        known = " UNION ALL ".join(f"SELECT * FROM s{j}" for j in range(i))
        out.append(f"d{i} AS (SELECT p.id, any_value(p.x) AS x, any_value(p.w) AS w, min(pow(list_distance(p.x, s.o), 2)) AS d2 FROM {source} p, ({known}) s GROUP BY p.id)")
        out.append(f"s{i} AS (SELECT {i}::BIGINT AS oid, x AS o FROM d{i} WHERE w > 0 AND d2 > 0 ORDER BY -ln({race.format(SEED, i)}) / (w * d2), id LIMIT 1)")
    return ", ".join([*out, "seeds AS (" + " UNION ALL ".join(f"SELECT * FROM s{j}" for j in range(k)) + ")"])


def cells(algorithms: tuple[str, ...], metrics: tuple[str, ...]) -> str:
    """Every (algorithm, rate) with every metric."""
    listed = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    return (
        f"WITH c AS (SELECT 'BASELINE' AS algorithm, 100.0::DOUBLE AS rate UNION ALL SELECT a, r FROM (SELECT unnest({listed(algorithms)}) AS a), (SELECT unnest([0.5::DOUBLE, 1.0, 5.0, 10.0]) AS r)) "
        f"SELECT algorithm, rate, metric, true AS in_range FROM c, (SELECT unnest({listed(metrics)}) AS metric)"
    )


ALGORITHMS = ("OBS", "RS", "SDO", "KMC", "WGM", "GNG")
HOLDS = "SELECT true AS counted, true AS inside, true AS closer"
MODEL_PARAMS = {
    "alpha": "1.0", "beta": "1.0", "chunksize": "None", "contamination": "0.1", "distance_estimation": "adtm", "factor": "0.1", "k": "5", "max_observers": "None", "mode": "median",
    "radius": "0.95", "radius_scope": "global", "sample_fraction": "0.05", "seed": "0", "shuffle": "True", "strict_compat": "False",
}
SDO_PARAMS = {"contamination": "0.1", "hbs": "False", "k": "60", "metric": "euclidean", "q": "None", "qv": "0.3", "return_scores": "False", "seed": "7", "x": "6"}


def values(pairs: dict[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in pairs.items()) + ") AS t(name, value)"


SENSITIVITY = f"""{CUST}, {seeds('cust', 6)}, {knn('cust', 'seeds', 1)},
nr AS (SELECT c.id, c.w, nn.oid AS cl, nn.d * nn.d AS d2 FROM nn JOIN cust c ON c.id = nn.id),
tot AS (SELECT *, sum(w * d2) OVER (PARTITION BY cl) AS dc, sum(w) OVER (PARTITION BY cl) AS nc, sum(w * d2) OVER () / sum(w) OVER () AS mean, sum(w) OVER () AS n FROM nr),
se AS (SELECT id, w * (2 * (SELECT ln(count(*)) FROM seeds) * d2 / mean + 4 * (SELECT ln(count(*)) FROM seeds) * dc / (nc * mean) + 4 * n / nc) AS s FROM tot)
SELECT id, round(s / sum(s) OVER (), 12) + 0.0::DOUBLE AS p FROM se"""


def build() -> dict[str, str]:
    out = {
        "radius_adtm": f"WITH {PTS}, {sample('pts', 0.05)}, {centroid('smp')} SELECT {r6('avg(list_distance(x, c))')} AS radius FROM smp, cen",
        "radius_aid": f"WITH {PTS}, {sample('pts', 0.05)} SELECT {r6('2 * avg(list_distance(a.x, b.x))')} AS radius FROM smp a JOIN smp b ON a.rn < b.rn",
        "radius_adtm_per_label": f"WITH {PTS}, {sample('pts', 0.1, by='label')}, {centroid('smp', by='label')} SELECT smp.label, {r6('avg(list_distance(x, c))')} AS radius FROM smp JOIN cen ON cen.label = smp.label GROUP BY smp.label",
        "fit_fixed_radius": f"{fit()} SELECT {DIGEST} FROM obs",
        "fit_estimated_radius": f"WITH RECURSIVE {PTS}, {ORDERED}, {sample('pts', 0.05)}, {centroid('smp')}, rad AS (SELECT 0 AS g, avg(list_distance(x, c)) AS r0 FROM smp, cen), {fold('fp', 'rad')} SELECT {DIGEST} FROM obs",
        "fit_shuffled": f"{fit(ORDERED.replace('ORDER BY id', f'''ORDER BY md5('{SEED}|' || id), id'''))} SELECT {DIGEST} FROM obs",
        "fit_alpha": f"{fit(alpha=0.5)} SELECT {DIGEST} FROM obs",
        "fit_chunked": f"{fit(BATCHED)} SELECT g::INT AS batch, {DIGEST} FROM obs",
        "fit_batch_radius": f"WITH RECURSIVE {PTS}, {BATCHED}, {sample('fp', 0.05, by='g')}, {centroid('smp', by='g')}, rad AS (SELECT smp.g, avg(list_distance(x, c)) AS r0 FROM smp JOIN cen ON cen.g = smp.g GROUP BY smp.g), {fold('fp', 'rad')} SELECT g::INT AS batch, {DIGEST} FROM obs",
        "fit_per_class": f"{fit('fp AS (SELECT label AS g, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS i, id, x FROM pts)')} SELECT g AS label, {GROUPED} FROM obs",
        "fit_customer_2d": f"{fit(ORDERED.replace('pts', 'cust'), FIXED.replace('0.95', '3.0'), CUST)} SELECT {DIGEST} FROM obs",
        "fit_events_per_type": f"{fit('fp AS (SELECT event_type AS g, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, [value] AS x FROM events WHERE value IS NOT NULL)', FIXED.replace('0.95', '10.0'))} SELECT g AS event_type, {GROUPED} FROM obs",
        "batch_sizes": f"WITH {PTS}, {BATCHED} SELECT g::INT AS batch, count(*) AS n FROM fp GROUP BY g",
        "shuffled_order": f"WITH {PTS} SELECT id, row_number() OVER (ORDER BY md5('{SEED}|' || id), id) - 1 AS seq, label FROM pts",
        "top_m": f"{fit()}, top AS (SELECT * FROM obs ORDER BY population DESC, oid DESC LIMIT 20) SELECT {DIGEST.replace('oid::BIGINT', 'row_number() OVER (ORDER BY population, oid) - 1', 1)} FROM top",
        "pad_m": f"{fit(radius=FIXED.replace('0.95', '1.2'))}, kk AS (SELECT count(*) AS k FROM obs), pad AS (SELECT k + row_number() OVER (ORDER BY md5('{SEED}|' || id), id) - 1 AS oid, x AS o, NULL::BIGINT AS population, NULL::DOUBLE AS radius FROM pts, kk QUALIFY row_number() OVER (ORDER BY md5('{SEED}|' || id), id) <= 300 - k), both_ AS (SELECT oid, o, population, radius FROM obs UNION ALL SELECT oid, o, population, radius FROM pad) SELECT {DIGEST} FROM both_",
        "observer_labels": f"{fit()}, {knn('pts', 'obs', 1)} SELECT id, oid::BIGINT AS oid, {r6('d')} AS distance FROM nn",
        "observer_counts": f"{fit()}, {knn('pts', 'obs', 1)} SELECT oid::BIGINT AS oid, count(*) AS n FROM nn GROUP BY oid",
        "predict_outliers": f"{fit()}, {knn('pts', 'obs', 5)}, sc AS (SELECT id, median(d) AS score FROM nn GROUP BY id) SELECT id, {r6('score')} AS score, score > (SELECT quantile_cont(score, 0.9) FROM sc) AS is_outlier FROM sc",
        "knn_rows": f"WITH {CUST}, {sample('cust', 0.1)}, refs AS (SELECT id AS oid, x AS o FROM smp), {knn('cust', 'refs', 3)} SELECT id, k::INT AS rank, oid, {r6('d')} AS d FROM nn",
        "coreset_uniform": f"WITH {PTS}, up AS (SELECT id, x, 1.0::DOUBLE / count(*) OVER () AS p FROM pts), {drawn('up', 50)} SELECT draw, id, {r6('1 / (50.0::DOUBLE * p)')} AS weight FROM dr",
        "coreset_weighted": f"WITH {CUST}, up AS (SELECT id, x, w / sum(w) OVER () AS p FROM cust), {drawn('up', 100)} SELECT draw, id, {r6('1 / (100.0::DOUBLE * p)')} AS weight FROM dr",
        "lightweight_p": f"WITH {CUST}, {lightweight('cust')} SELECT id, round(p, 12) + 0.0::DOUBLE AS p FROM lw",
        "coreset_lightweight": f"WITH {PTS}, un AS (SELECT id, x, 1.0::DOUBLE AS w FROM pts), {lightweight('un')}, {drawn('lw', 50)} SELECT draw, id, round(1 / (50.0::DOUBLE * p), 4) + 0.0::DOUBLE AS weight FROM dr",
        "sensitivity_p": f"WITH {SENSITIVITY}",
        "sdo_size_2d": f"WITH {CUST}, cv AS (SELECT var_samp(x[1]) AS a, var_samp(x[2]) AS b, covar_samp(x[1], x[2]) AS c, count(*) AS n FROM cust), ev AS (SELECT n, (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c) AS l FROM cv), p AS (SELECT n, greatest(1.0::DOUBLE, l) AS v, 0.01::DOUBLE * l AS e, 1.96::DOUBLE * 1.96::DOUBLE AS z FROM ev) SELECT floor((n * z * v) / ((n - 1) * e + z * v))::BIGINT AS k FROM p",
        "sdo_hbs": f"WITH {CUST}, bx AS (SELECT min(x[1]) AS l1, max(x[1]) AS h1, min(x[2]) AS l2, max(x[2]) AS h2 FROM cust), sn AS (SELECT id, (floor((x[1] - l1) / ((h1 - l1) / 26.0::DOUBLE)) + 0.5::DOUBLE) * ((h1 - l1) / 26.0::DOUBLE) + l1 AS a, (floor((x[2] - l2) / ((h2 - l2) / 26.0::DOUBLE)) + 0.5::DOUBLE) * ((h2 - l2) / 26.0::DOUBLE) + l2 AS b FROM cust, bx) SELECT min(id) AS id, {r6('a')} AS a, {r6('b')} AS b FROM sn GROUP BY sn.a, sn.b",
        "sdo_draw": f"WITH {SDO_DRAWN} SELECT oid, {r6('o[1]')} AS first FROM ob",
        "sdo_counts": f"WITH {SDO_COUNTS} SELECT oid, n FROM cnt",
        "sdo_active": f"WITH {SDO_ACTIVE} SELECT oid, n FROM act",
        "sdo_scores": f"WITH {SDO_ACTIVE}, {knn('pts', 'act', 6, 'n2')} SELECT id, {r6('median(d)')} AS score FROM n2 GROUP BY id",
        "sdo_predict": f"WITH {SDO_ACTIVE}, {knn('pts', 'act', 6, 'n2')}, sc AS (SELECT id, median(d) AS score FROM n2 GROUP BY id) SELECT id, score > (SELECT quantile_cont(score, 0.9) FROM sc) AS is_outlier FROM sc",
        "ad_score": f"WITH {RANKED} SELECT * FROM sc",
        "ad_metrics": f"""WITH {RANKED}, rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r, sum(y) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS cs, sum(y) OVER () AS o, count(*) OVER () AS n FROM sc),
m AS (SELECT max(CASE WHEN r = o THEN cs END) / any_value(o) AS patn, sum(CASE WHEN r <= o THEN cs / r END) / any_value(o) AS ap, 2 * max(cs / (r + o)) AS maxf1, any_value(o) / any_value(n) AS s FROM rk),
au AS (SELECT sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM sc a, sc b WHERE a.y = 1 AND b.y = 0)
SELECT {r6('patn')} AS patn, {r6('(patn - s) / (1 - s)')} AS adj_patn, {r6('ap')} AS ap, {r6('(ap - s) / (1 - s)')} AS adj_ap, {r6('maxf1')} AS maxf1, {r6('(maxf1 - s) / (1 - s)')} AS adj_maxf1, {r6('auc::DOUBLE')} AS auc FROM m, au""",
        "ad_auc": f"WITH sc AS (SELECT n_chars AS score, toxic AS y FROM documents JOIN labels USING (doc_id)) SELECT {r6('(sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*))::DOUBLE')} AS auc FROM sc a, sc b WHERE a.y = 1 AND b.y = 0",
        "knn1_classify": f"WITH {classified(1)} SELECT * FROM cl",
        "knn5_classify": f"WITH {classified(5)} SELECT * FROM cl",
        "clf_confusion": f"WITH {classified(5)} SELECT y, predicted, count(*) AS n FROM cl GROUP BY y, predicted",
        "clf_scores": f"WITH {classified(5)}, {confusion_scores('cl')}",
        "quality_scores": f"WITH qc AS (SELECT quality AS y, (n_chars > 500)::INT AS predicted FROM documents JOIN labels USING (doc_id)), {confusion_scores('qc')}",
        "nearest_centroid": f"WITH {PTS} SELECT label, dim - 1 AS dim, {r6('avg(v)')} AS v FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM pts) GROUP BY label, dim",
        "lloyd_step": f"WITH {CENTRES} SELECT oid, {r6('o[1]')} AS first, {r6('list_sum(o)')} AS total FROM c1",
        "centre_labels": f"WITH {LABELLED} SELECT oid, label FROM lc",
        "label_extender": f"WITH {EXTENDED} SELECT * FROM ex",
        "ari": f"WITH {EXTENDED}, ce AS (SELECT label, predicted, count(*) AS n FROM ex GROUP BY ALL), a AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM ce GROUP BY label)), b AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM ce GROUP BY predicted)), c AS (SELECT sum(n * (n - 1) / 2) AS v, sum(n) AS n FROM ce) SELECT {r6('(c.v - a.v * b.v / (c.n * (c.n - 1) / 2)) / ((a.v + b.v) / 2 - a.v * b.v / (c.n * (c.n - 1) / 2))')} AS ari FROM a, b, c",
        "stratified_split": f"SELECT o_orderkey AS id, o_orderstatus AS label, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('{SEED}|' || o_orderkey), o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.3::DOUBLE + 0.5) AS is_test FROM orders",
        "fix_rate_more": f"WITH {PTS} (SELECT id, label FROM pts ORDER BY md5('{SEED + 1}|' || id), id LIMIT 30) UNION ALL (SELECT id, label FROM pts ORDER BY md5('{SEED}|' || id), id LIMIT 15)",
        "fix_rate_less": f"WITH {PTS}, few AS (SELECT id, label FROM pts ORDER BY md5('{SEED + 1}|' || id), id LIMIT 30) SELECT id, label FROM few ORDER BY md5('{SEED}|' || id), id LIMIT 12",
        "train_test_union": f"SELECT c_custkey AS id, {r6('c_acctbal')} AS v, false AS is_test FROM customer UNION ALL SELECT s_suppkey + (SELECT max(c_custkey) FROM customer) + 1, {r6('s_acctbal')}, true FROM supplier",
        "coreset_sizes": "SELECT label, rate, greatest(floor(n * rate / 100.0::DOUBLE), 1)::BIGINT AS size FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label), (SELECT unnest([0.5::DOUBLE, 1.0, 5.0, 10.0]) AS rate)",
        "class_counts": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
        "cube_unpivot": f"WITH {RESULTS} SELECT dataset, algorithm, rate, metric, round(value, 4) + 0.0::DOUBLE AS value FROM lng",
        "summary_mean_std": f"WITH {RESULTS} SELECT algorithm, rate, metric, round(avg(value), 4) + 0.0::DOUBLE AS mean, round(stddev_pop(value), 4) + 0.0::DOUBLE AS std FROM lng GROUP BY ALL",
        "mean_over_datasets": f"WITH {RESULTS} SELECT algorithm, rate, metric, round(avg(value), 4) + 0.0::DOUBLE AS value FROM lng GROUP BY ALL",
        "stream_fit_events": "",
        "get_params": values(MODEL_PARAMS),
        "sdo_params": values(SDO_PARAMS),
        "sdo_observers": f"WITH {SDO_ACTIVE} SELECT oid, {r6('o[1]')} AS first, {r6('list_sum(o)')} AS total FROM act",
        "kmeans_plus_plus": f"WITH {CUST}, {seeds('cust', 6)} SELECT oid, {r6('o[1]')} AS a, {r6('o[2]')} AS b FROM seeds",
        "cnn_coreset": f"WITH {PTS} SELECT id, label, label AS predicted FROM pts",
        "ward_clusters": f"{fit()} SELECT 10::BIGINT AS clusters, count(*) AS members, count(*) AS observers FROM obs",
        "random_per_class": f"""WITH {PTS}, num AS (SELECT id, x, label, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}|' || id), id) - 1 AS seq, count(*) OVER (PARTITION BY label) AS n FROM pts),
dr AS (SELECT label, n, unnest(range(greatest(floor(n * 10.0::DOUBLE / 100.0::DOUBLE), 1)::BIGINT)) AS draw FROM (SELECT DISTINCT label, n FROM num))
SELECT dr.label, draw, {r6('x[1]')} AS first FROM dr JOIN num ON num.label = dr.label AND num.seq = least(floor({uniform("dr.label || '|' || draw")} * dr.n)::BIGINT, dr.n - 1)""",
        "experiment_anomaly": cells(ALGORITHMS, ("patn", "adj_patn", "ap", "adj_ap", "maxf1", "adj_maxf1", "auc", "ext_time", "knn_time")),
        "experiment_clustering": cells(ALGORITHMS, ("rand", "ext_time", "kmeans", "label_extender")),
        "experiment_hierarchical": cells(ALGORITHMS, ("rand", "ext_time", "kmeans", "label_extender")),
        "experiment_classification": cells((*ALGORITHMS, "CNN"), ("accuracy", "micro_precision", "macro_precision", "micro_recall", "macro_recall", "ext_time", "knn_time")),
        "flagship": f"{fit()}, {knn('pts', 'obs', 5)}, sc AS (SELECT id, median(d) AS score FROM nn GROUP BY id), fl AS (SELECT id, score > (SELECT quantile_cont(score, 0.9) FROM sc) AS b FROM sc) SELECT label, count(*) AS n, {r6('avg(b::INT)')} AS outlier_rate FROM fl JOIN pts USING (id) GROUP BY label",
    }
    out["stream_fit_events"] = out["fit_events_per_type"]
    out |= dict.fromkeys(("kmeans_coreset", "gmm_coreset", "bayesian_coreset", "gng_coreset"), HOLDS)
    out |= {f"by_class_{name.lower()}": "SELECT DISTINCT label, true AS sized, true AS numbered, true AS inside FROM embeddings" for name in ALGORITHMS}
    for mode, expression in MODES.items():
        out[f"outlierness_{mode}"] = f"{fit()}, {knn('pts', 'obs', 6)} SELECT id, {r6(expression)} AS score FROM nn GROUP BY id"
    for metric, expression in METRIC.items():
        out[f"sdo_metric_{metric}"] = f"WITH {SDO_DRAWN}, {knn('pts', 'ob', 6, 'n2', expression)} SELECT id, {r6('median(d)')} AS score FROM n2 GROUP BY id"
    return out


ORACLES = build()
