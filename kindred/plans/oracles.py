"""The same results as plain SQL for DuckDB, written from the definitions: dense vectors, row-wise
gaps and all-pairs joins instead of the sparse and blocked forms the operators use."""

from __future__ import annotations

from kindred.plans.tables import MARK_EPOCH

# ROUNDS lies past the fixed point; the SQL fails if the last two rounds differ.
K, ROUNDS, DIMS = 5, 22, 64
GAP = 6 * 3600 * 1_000_000

R0 = """r0 AS (SELECT o_custkey AS user_id, l_partkey AS item_id,
  CAST(floor((l_quantity - 1) / 10) + 1 AS DOUBLE) AS rating, CAST(epoch(o_orderdate) AS BIGINT) AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
R = R0 + """, r AS (SELECT user_id, item_id, rating, ts FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id, item_id ORDER BY ts DESC, rating DESC) AS k FROM r0) WHERE k = 1)"""
A = "a AS (SELECT user_id, avg(rating) AS m, count(*) AS n FROM r GROUP BY user_id)"
IMPORTANCE = "CAST(count(*) + count(DISTINCT rating) AS BIGINT) AS importance"
SPLIT = f"train AS (SELECT * FROM r WHERE ts <= {MARK_EPOCH}), test AS (SELECT * FROM r WHERE ts > {MARK_EPOCH})"


def _sim(source: str, name: str = "s", within: str | None = None, strict: bool = False) -> str:
    """Directed factors and score of all pairs with a common item in relation `source`."""
    same = f"AND x.{within} = y.{within}" if within else ""
    kept = f"x.{within} AS {within}, " if within else ""
    out = f"{within}, " if within else ""
    agree = "x.side * y.side > 0" if strict else "x.side * y.side >= 0"
    parts = " + ".join(f"CASE WHEN {f} <> 0 THEN 1.0 / {f} ELSE 0 END" for f in ("rc", "ru", "rd", "rt"))
    return f"""{name}_a AS (SELECT user_id, avg(rating) AS m, count(*) AS n FROM {source} GROUP BY user_id),
{name}_q AS (SELECT b.*, CAST(sign(b.rating - m) AS INTEGER) AS side, n FROM {source} b JOIN {name}_a USING (user_id)),
{name}_p AS (SELECT {kept}x.user_id AS user_u, y.user_id AS user_v, CAST(count(*) AS BIGINT) AS rc,
  CAST(any_value(y.n) - count(*) AS BIGINT) AS ru,
  CAST(sum(CASE WHEN {agree} THEN 1 ELSE 0 END) AS BIGINT) AS rd,
  sum(exp(-1e-6 * abs(x.ts - y.ts))) AS rt
  FROM {name}_q x JOIN {name}_q y ON x.item_id = y.item_id AND x.user_id <> y.user_id {same}
  GROUP BY ALL),
{name} AS (SELECT {out}user_u, user_v, rc, ru, rd, rt, 1.0 / (1.0 + ({parts})) AS mfps FROM {name}_p)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


TOP = """top AS (SELECT user_id FROM (SELECT user_id, count(*) + count(DISTINCT rating) AS f FROM r GROUP BY user_id)
  ORDER BY f DESC, user_id LIMIT 1)"""
ASKED = TOP + """, asked AS (SELECT DISTINCT r.user_id AS user_u, top.user_id AS user_v FROM r, top
  WHERE r.user_id <> top.user_id)"""


def _predict(fallback: str = "u.m", low: bool = True) -> str:
    clamp = (lambda x: f"greatest(1.0, least(5.0, {x}))") if low else (lambda x: f"least(5.0, {x})")
    other = clamp(fallback) if fallback == "u.m" else fallback
    return _with(R, SPLIT, _sim("train", "s0"),
                 "s AS (SELECT user_u, user_v, mfps AS sim FROM s0)",
                 "ta AS (SELECT user_id, avg(rating) AS m FROM train GROUP BY user_id)",
                 """near AS (SELECT t.user_id, t.item_id, s.sim, b.rating - v.m AS dev,
  row_number() OVER (PARTITION BY t.user_id, t.item_id ORDER BY s.sim DESC, s.user_v) AS k
  FROM test t JOIN train b ON b.item_id = t.item_id AND b.user_id <> t.user_id
  JOIN s ON s.user_u = t.user_id AND s.user_v = b.user_id JOIN ta v ON v.user_id = b.user_id)""",
                 """w AS (SELECT user_id, item_id, sum(sim * dev) AS num, sum(abs(sim)) AS den, count(*) AS n
  FROM near WHERE k <= 50 GROUP BY ALL)""",
                 f"""p AS (SELECT t.user_id, t.item_id, CASE WHEN w.den > 0 THEN {clamp('u.m + w.num / w.den')}
  ELSE {other} END AS prediction, CAST(coalesce(w.n, 0) AS BIGINT) AS n_neighbours
  FROM test t JOIN ta u USING (user_id) LEFT JOIN w USING (user_id, item_id))""")


# --- clustering: dense matrix, one column of SQL per loop round ---------------------------------

DENSE = """i AS (SELECT DISTINCT item_id FROM r),
x AS MATERIALIZED (SELECT a.user_id, i.item_id, coalesce(r.rating, a.m) AS v
  FROM a CROSS JOIN i LEFT JOIN r ON r.user_id = a.user_id AND r.item_id = i.item_id),
f AS (SELECT user_id, CAST(count(*) + count(DISTINCT rating) AS BIGINT) AS f FROM r GROUP BY user_id),
m AS (SELECT CAST(floor(count(*) / %d / 1.5) AS BIGINT) + 1 AS m FROM a)""" % K


def _seeds(count: int = K, members: bool = False, scale: str = "f") -> str:
    """seed0..: the chosen users; near0..: distances of the pool to each seed, ranked."""
    ctes = ["seed0 AS MATERIALIZED (SELECT user_id, CAST(f AS DOUBLE) AS score FROM f ORDER BY f DESC, user_id LIMIT 1)"]
    pool = "f"
    for t in range(count):
        if t and t < count:
            ctes.append(f"""seed{t} AS MATERIALIZED (SELECT user_id, f / (SELECT max(f) FROM {scale.replace("{t}", str(t))})
  + d / (SELECT max(d) FROM pool{t}) AS score FROM pool{t} ORDER BY score DESC, user_id LIMIT 1)""")
        if t < count - 1 or members:
            ctes.append(f"""near{t} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY d, user_id) AS k FROM (
  SELECT x.user_id, any_value(p.f) AS f, sqrt(sum((x.v - c.v) * (x.v - c.v))) AS d
  FROM x JOIN {pool} p ON p.user_id = x.user_id
  JOIN x c ON c.item_id = x.item_id AND c.user_id = (SELECT user_id FROM seed{t}) GROUP BY x.user_id))""")
            ctes.append(f"pool{t + 1} AS MATERIALIZED (SELECT user_id, f, d FROM near{t} WHERE k > (SELECT m FROM m))")
            pool = f"pool{t + 1}"
    every = " UNION ALL ".join(f"SELECT {t} AS ordinal, user_id AS label, score FROM seed{t}" for t in range(count))
    ctes.append(f"seeds AS MATERIALIZED ({every})")
    return ",\n".join(ctes)


def _rounds(rounds: int) -> str:
    ctes = ["c0 AS MATERIALIZED (SELECT s.ordinal, s.label, x.item_id, x.v FROM x JOIN seeds s ON s.label = x.user_id)"]
    for t in range(rounds + 1):
        ctes.append(f"""l{t} AS MATERIALIZED (SELECT user_id, ordinal, label, d FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY d, ordinal) AS k FROM (SELECT x.user_id, c.ordinal, c.label,
  sqrt(sum((x.v - c.v) * (x.v - c.v))) AS d FROM x JOIN c{t} c ON c.item_id = x.item_id GROUP BY ALL)) WHERE k = 1)""")
        if t < rounds:
            ctes.append(f"""c{t + 1} AS MATERIALIZED (SELECT l.ordinal, l.label, x.item_id, avg(x.v) AS v
  FROM x JOIN l{t} l ON l.user_id = x.user_id GROUP BY ALL
  UNION ALL SELECT * FROM c{t} WHERE ordinal NOT IN (SELECT ordinal FROM l{t}))""")
    return ",\n".join(ctes)


CLUSTERED = (R, A, DENSE, _seeds(), _rounds(ROUNDS), f"""refined AS MATERIALIZED (SELECT * FROM l{ROUNDS} WHERE CASE WHEN EXISTS (
  SELECT 1 FROM l{ROUNDS} x JOIN l{ROUNDS - 1} y USING (user_id) WHERE x.ordinal <> y.ordinal)
  THEN error('users still change clusters') ELSE true END)""")
LABELS = "SELECT user_id, label FROM refined"
FIRST = (R, A, DENSE, _seeds(2))

# --- sessions -----------------------------------------------------------------------------------

EVENTS = """e AS (SELECT user_id, epoch_us(ts) AS ts, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS item_id,
  CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 END AS action,
  CASE event_type WHEN 'click' THEN 0.2::DOUBLE WHEN 'purchase' THEN 0.5::DOUBLE WHEN 'view' THEN 0.3::DOUBLE END AS weight
  FROM events)"""


def _cut(source: str, prefix: str = "") -> str:
    return f"""{prefix}g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < {GAP} THEN 0 ELSE 1 END AS st
  FROM {source}),
{prefix}h AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM {prefix}g),
{prefix}ev AS (SELECT *, min(ts) OVER (PARTITION BY user_id, nth) AS created_at,
  user_id || '-' || min(ts) OVER (PARTITION BY user_id, nth) AS session_id FROM {prefix}h),
{prefix}sess AS (SELECT DISTINCT session_id, user_id, created_at FROM {prefix}ev)"""


SESSIONS = EVENTS + ",\n" + _cut("e")
RECENT = """recent AS (SELECT ev.user_id, ev.session_id, ev.created_at, ev.item_id, ev.weight FROM ev JOIN (
  SELECT session_id FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY created_at DESC) AS k FROM sess) WHERE k <= 4)
  USING (session_id) WHERE action IS NOT NULL)"""
LATEST = """latest AS (SELECT * FROM (SELECT ev.user_id, ev.session_id, ev.created_at, CAST(ev.item_id AS VARCHAR) AS content,
  ev.ts AS searched_at, CAST(row_number() OVER (PARTITION BY ev.user_id
    ORDER BY ev.created_at DESC, ev.ts DESC, CAST(ev.item_id AS VARCHAR)) AS INTEGER) AS rank
  FROM ev JOIN (SELECT user_id, max(created_at) AS created_at FROM sess GROUP BY user_id) USING (user_id, created_at)
  WHERE event_type = 'signup') WHERE rank <= 10)"""
VECTORS = "vec AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _knn(queries: str, k: int, name: str) -> str:
    """Nearest items of relation `queries` (query_id, e)."""
    return f"""{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)
  AS INTEGER) AS rank FROM (SELECT q.query_id, i.item_id, round(list_cosine_similarity(q.e, i.e), 10) AS score
  FROM {queries} q, vec i)) WHERE rank <= {k})"""


CONTENTS = """contents AS (SELECT DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'signup')"""
RANKED = (SESSIONS, RECENT, LATEST, VECTORS,
          "asked AS (SELECT DISTINCT content AS query_id, e FROM latest JOIN vec ON CAST(vec.item_id AS VARCHAR) = content)",
          _knn("asked", 20, "hits"),
          """ranked AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id)
  AS INTEGER) AS rank FROM (SELECT l.user_id, h.item_id, max(round(list_cosine_similarity(c.e, o.e), 10) * w.weight) AS score
  FROM latest l JOIN hits h ON h.query_id = l.content JOIN recent w ON w.user_id = l.user_id
  JOIN vec c ON c.item_id = h.item_id JOIN vec o ON o.item_id = w.item_id GROUP BY ALL)) WHERE rank <= 10)""")
RECOMMENDED = RANKED + (
    R, A, _sim("r", "s0"), "s AS (SELECT user_u, user_v, mfps AS sim FROM s0)",
    "t AS (SELECT user_id, item_id FROM ranked WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM r))",
    """near AS (SELECT t.user_id, t.item_id, s.sim, b.rating - v.m AS dev,
  row_number() OVER (PARTITION BY t.user_id, t.item_id ORDER BY s.sim DESC, s.user_v) AS k
  FROM t JOIN r b ON b.item_id = t.item_id JOIN s ON s.user_u = t.user_id AND s.user_v = b.user_id
  JOIN a v ON v.user_id = b.user_id)""",
    "w AS (SELECT user_id, item_id, sum(sim * dev) AS num, sum(abs(sim)) AS den FROM near WHERE k <= 50 GROUP BY ALL)",
    """p AS (SELECT t.user_id, t.item_id, greatest(1.0, least(5.0, u.m + coalesce(w.num / w.den, 0))) AS prediction
  FROM t JOIN a u USING (user_id) LEFT JOIN w USING (user_id, item_id))""",
    """rec AS (SELECT user_id, item_id, round(prediction, 6) AS prediction, CAST(row_number() OVER (
  PARTITION BY user_id ORDER BY round(p.prediction, 8) DESC, item_id) AS INTEGER) AS rank FROM p QUALIFY rank <= 10)""")


def _weights(corpus_filter: str = "") -> str:
    """Hashed TF-IDF weights of the documents, length 1 each."""
    return f"""docs AS (SELECT doc_id AS item_id, text FROM documents {corpus_filter}),
words AS (SELECT item_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM docs),
tf AS (SELECT item_id, CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {DIMS} AS INTEGER) AS slot, count(*) AS tf
  FROM words WHERE w <> '' GROUP BY ALL),
idf AS (SELECT slot, ln(((SELECT count(*) FROM docs) + 1.0) / (count(*) + 1.0)) AS idf FROM tf GROUP BY slot),
raw AS (SELECT item_id, slot, tf * idf AS weight FROM tf JOIN idf USING (slot) WHERE tf * idf <> 0),
weights AS (SELECT item_id, slot, weight / sqrt(sum(weight * weight) OVER (PARTITION BY item_id)) AS weight FROM raw)"""


CLOSED = f"""closed AS (SELECT user_id, created_at, max(ts) AS ended_at, count(*) AS n_actions, sum(weight) AS weight
  FROM zev GROUP BY user_id, created_at
  HAVING max(ts) + {GAP} <= (SELECT max(ts) FROM zev) - 3600000000)"""
STREAMED = (EVENTS, "z AS (SELECT * FROM e WHERE action IS NOT NULL)", _cut("z", "z"), CLOSED)

MFPS_COLUMNS = "user_u, user_v, rc, ru, rd, round(rt, 6) AS rt, round(mfps, 6) AS mfps"
SCORES = "SELECT user_u, user_v, round(mfps, 6) AS mfps FROM s"
CHANGED = f"changed AS (SELECT DISTINCT user_id FROM r0 WHERE ts > {MARK_EPOCH})"
CELL_SUMS = """count(*) AS n_cells, round(sum(v), 4) AS sum_value,
  round(sum(v * item_id) / CAST(sum(item_id + 1) AS DOUBLE), 4) AS mean_by_item"""

ORACLES = {
    "read_ratings": _with(R0) + "SELECT user_id, item_id, rating, ts, count(*) AS copies FROM r0 GROUP BY ALL",
    "ratings_dedup": _with(R) + "SELECT * FROM r",
    "ratings_kv_roundtrip": _with(R) + "SELECT * FROM r",
    "user_values_roundtrip": _with(R, A) + "SELECT user_id, round(m, 6) AS avg_rating FROM a",
    "user_list": _with(R0) + "SELECT DISTINCT user_id FROM r0",
    "item_list": _with(R0) + "SELECT DISTINCT item_id FROM r0",
    "avg_rating": _with(R0) + "SELECT user_id, round(avg(rating), 6) AS avg_rating FROM r0 GROUP BY user_id",
    "importance": _with(R0) + f"SELECT user_id, {IMPORTANCE} FROM r0 GROUP BY user_id",
    "items_per_user": _with(R) + "SELECT user_id, count(*) AS n_items FROM r GROUP BY user_id",
    "top_user": _with(R0) + f"SELECT user_id, {IMPORTANCE} FROM r0 GROUP BY user_id ORDER BY importance DESC, user_id LIMIT 1",
    "max_scale": _with(R0, f"f AS (SELECT user_id, {IMPORTANCE} FROM r0 GROUP BY user_id)")
    + "SELECT user_id, importance, round(importance / (SELECT max(importance) FROM f), 6) AS scaled FROM f",
    "rating_total": _with(R0) + "SELECT sum(rating) AS total, count(*) AS n_ratings FROM r0",
    "high_water_mark": _with(R0) + "SELECT max(ts) AS ts FROM r0",

    "corated_pairs": _with(R) + """SELECT x.user_id AS user_u, y.user_id AS user_v, x.item_id, x.rating AS rating_u,
  y.rating AS rating_v, x.ts AS ts_u, y.ts AS ts_v FROM r x JOIN r y ON x.item_id = y.item_id AND x.user_id < y.user_id""",
    "rating_commodity": _with(R, _sim("r")) + "SELECT user_u, user_v, rc FROM s",
    "rating_usefulness": _with(R, _sim("r")) + "SELECT user_u, user_v, ru FROM s",
    "rating_details": _with(R, _sim("r")) + "SELECT user_u, user_v, rd FROM s",
    "rating_details_strict": _with(R, _sim("r", strict=True)) + "SELECT user_u, user_v, rd FROM s",
    "rating_time": _with(R, _sim("r")) + "SELECT user_u, user_v, round(rt, 6) AS rt FROM s",
    "mfps": _with(R, _sim("r")) + f"SELECT {MFPS_COLUMNS} FROM s",
    "combine_factors": _with(R, _sim("r")) + SCORES,
    "gather_factors": _with(R, _sim("r")) + """SELECT user_u, user_v, CAST(rc AS DOUBLE) AS rc, CAST(ru AS DOUBLE) AS ru,
  CAST(rd AS DOUBLE) AS rd, round(rt, 6) AS rt FROM s""",
    "neighbours_top_k": _with(R, _sim("r")) + """SELECT user_u, user_v, round(mfps, 6) AS mfps, rank FROM (SELECT user_u, user_v,
  mfps, CAST(row_number() OVER (PARTITION BY user_u ORDER BY mfps DESC, user_v) AS INTEGER) AS rank FROM s)
  WHERE rank <= 50""",
    "stranger_scores": _with(R, A) + "SELECT user_id AS user_v, round(1 / (1 + 1.0 / n), 6) AS stranger FROM a",
    "similarity_of_zero": _with(R, _sim("r"), ASKED)
    + "SELECT user_u, user_v, round(coalesce(mfps, 0.0), 6) AS mfps FROM asked LEFT JOIN s USING (user_u, user_v)",
    "similarity_of_drop": _with(R, _sim("r"), ASKED)
    + "SELECT user_u, user_v, round(mfps, 6) AS mfps FROM asked JOIN s USING (user_u, user_v)",
    "similarity_of_skip": _with(R, A, _sim("r"), ASKED) + """SELECT user_u, user_v, round(coalesce(mfps, 1 / (1 + 1.0 / a.n)), 6) AS mfps
  FROM asked JOIN a ON a.user_id = user_v LEFT JOIN s USING (user_u, user_v)""",

    "predict_ratings": _predict() + "SELECT user_id, item_id, round(prediction, 6) AS prediction, n_neighbours FROM p",
    "predict_ratings_offline": _predict("-1.0", low=False)
    + "SELECT user_id, item_id, round(prediction, 6) AS prediction, n_neighbours FROM p",
    "recommend_top_n": _predict() + """SELECT user_id, item_id, round(prediction, 6) AS prediction, CAST(row_number() OVER (
  PARTITION BY user_id ORDER BY round(prediction, 8) DESC, item_id) AS INTEGER) AS rank FROM p QUALIFY rank <= 5""",
    "evaluate_ranking": _predict() + """, rec AS (SELECT user_id, item_id, row_number() OVER (
  PARTITION BY user_id ORDER BY round(prediction, 8) DESC, item_id) AS rank FROM p QUALIFY rank <= 5),
rel AS (SELECT t.user_id, t.item_id FROM test t JOIN ta USING (user_id) WHERE t.rating >= ta.m),
rel_n AS (SELECT user_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY item_id) AS ids FROM rel GROUP BY user_id),
rec_n AS (SELECT user_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY rank) AS ids FROM rec GROUP BY user_id),
hit_n AS (SELECT user_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY rank) AS ids
  FROM rec JOIN rel USING (user_id, item_id) GROUP BY user_id),
c AS (SELECT user_id, coalesce(rec_n.n, 0) AS n_recommended, rel_n.n AS n_relevant, coalesce(hit_n.n, 0) AS n_hit,
  coalesce(rec_n.ids, '') AS recommended, rel_n.ids AS relevant_items, coalesce(hit_n.ids, '') AS hits
  FROM rel_n LEFT JOIN rec_n USING (user_id) LEFT JOIN hit_n USING (user_id))
SELECT *, round(n_hit / 5, 6) AS precision, round(n_hit / n_relevant, 6) AS recall,
  round(CASE WHEN n_hit > 0 THEN 2 * (n_hit / 5) * (n_hit / n_relevant) / (n_hit / 5 + n_hit / n_relevant) ELSE 0.0 END, 6) AS f1
  FROM c""",
    "evaluate_user_range": _predict() + """, rec AS (SELECT user_id, item_id, row_number() OVER (
  PARTITION BY user_id ORDER BY round(prediction, 8) DESC, item_id) AS rank FROM p QUALIFY rank <= 5),
rel AS (SELECT t.user_id, t.item_id FROM test t JOIN ta USING (user_id) WHERE t.rating >= ta.m),
rel_n AS (SELECT user_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY item_id) AS ids FROM rel GROUP BY user_id),
rec_n AS (SELECT user_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY rank) AS ids FROM rec GROUP BY user_id),
hit_n AS (SELECT user_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY rank) AS ids
  FROM rec JOIN rel USING (user_id, item_id) GROUP BY user_id),
c AS (SELECT user_id, coalesce(rec_n.n, 0) AS n_recommended, rel_n.n AS n_relevant, coalesce(hit_n.n, 0) AS n_hit,
  coalesce(rec_n.ids, '') AS recommended, rel_n.ids AS relevant_items, coalesce(hit_n.ids, '') AS hits
  FROM rel_n LEFT JOIN rec_n USING (user_id) LEFT JOIN hit_n USING (user_id))
SELECT *, round(n_hit / 5, 6) AS precision, round(n_hit / n_relevant, 6) AS recall,
  round(CASE WHEN n_hit > 0 THEN 2 * (n_hit / 5) * (n_hit / n_relevant) / (n_hit / 5 + n_hit / n_relevant) ELSE 0.0 END, 6) AS f1
  FROM c WHERE user_id BETWEEN 100 AND 600""",
    "rating_errors": _predict() + """SELECT user_id, item_id, round(prediction, 6) AS prediction, rating,
  round((prediction - rating) * (prediction - rating), 6) AS sq_err FROM p JOIN test USING (user_id, item_id)""",
    "evaluate_rating_error": _predict() + """SELECT count(*) AS n, round(sqrt(avg((prediction - rating) * (prediction - rating))), 6) AS rmse,
  round(avg(abs(prediction - rating)), 6) AS mae FROM p JOIN test USING (user_id, item_id)""",

    "user_profile": _with(R, A) + "SELECT user_id, round(m, 6) AS base, item_id, round(rating - m, 6) AS dev FROM r JOIN a USING (user_id)",
    "dense_matrix": _with(R, A, DENSE) + f"SELECT user_id, CAST(floor(item_id / 1024) AS BIGINT) AS block, {CELL_SUMS} FROM x GROUP BY ALL",
    "packed_matrix_roundtrip": _with(*CLUSTERED) + "SELECT user_id, item_id, round(v, 6) AS value, label FROM x JOIN refined USING (user_id)",
    "pick_centroid": _with(R, A, TOP) + """SELECT user_id AS label, round(m, 6) AS base, item_id, round(rating - m, 6) AS dev
  FROM r JOIN a USING (user_id) JOIN top USING (user_id)""",
    "distance_to_centroid": _with(*FIRST) + "SELECT user_id, round(d, 5) AS distance FROM near0",
    "m_nearest": _with(*FIRST) + "SELECT user_id, round(d, 5) AS distance FROM near0 WHERE k <= (SELECT m FROM m)",
    "discard_users": _with(*FIRST) + "SELECT user_id, f AS importance FROM pool1",
    "seed_score": _with(*FIRST) + """SELECT user_id, f AS importance, round(d, 5) AS distance,
  round(f / (SELECT max(f) FROM f) + d / (SELECT max(d) FROM pool1), 5) AS score FROM pool1""",
    "seed_centroids_pool": _with(R, A, DENSE, _seeds(scale="pool{t}")) + "SELECT ordinal, label, round(score, 5) AS score FROM seeds",
    "seed_centroids": _with(R, A, DENSE, _seeds()) + "SELECT ordinal, label, round(score, 5) AS score FROM seeds",
    "seed_labels": _with(R, A, DENSE, _seeds(members=True), _rounds(0)) + ", taken AS ("
    + " UNION ALL ".join(f"SELECT user_id, (SELECT user_id FROM seed{t}) AS label FROM near{t} WHERE k <= (SELECT m FROM m)"
                         for t in range(K))
    + ") SELECT * FROM taken UNION ALL SELECT user_id, label FROM l0 WHERE user_id NOT IN (SELECT user_id FROM taken)",
    "assign_clusters": _with(R, A, DENSE, _seeds(), _rounds(0)) + "SELECT user_id, label, round(d, 5) AS distance FROM l0",
    "update_centroids": _with(R, A, DENSE, _seeds(), _rounds(1)) + """SELECT label, item_id, round(v, 5) AS value FROM c1
  WHERE (label, item_id) IN (SELECT (label, item_id) FROM l0 JOIN r USING (user_id))""",
    "refine_clusters": _with(*CLUSTERED) + f"SELECT user_id, label, round(d, 5) AS distance FROM refined",
    "avg_rating_by_label": _with(*CLUSTERED) + f"SELECT user_id, label, round(m, 6) AS avg_rating FROM refined JOIN a USING (user_id)",
    "write_labels": _with(*CLUSTERED) + LABELS,
    "write_clusters": _with(*CLUSTERED) + f"""SELECT user_id, item_id, rating, ts, round(m, 6) AS avg_rating, label
  FROM r JOIN a USING (user_id) JOIN refined USING (user_id)""",
    "mfps_within_cluster": _with(*CLUSTERED, f"lr AS (SELECT r.*, label FROM r JOIN refined USING (user_id))",
                                 _sim("lr", within="label")) + f"SELECT label, {MFPS_COLUMNS} FROM s",

    "extract_item_id": "SELECT vec_id AS item_id FROM embeddings",
    "item_embeddings": _with(R0) + """SELECT vec_id AS item_id, CAST(len(embedding) AS INTEGER) AS n_dims,
  round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))), 5) AS length
  FROM embeddings WHERE vec_id IN (SELECT item_id FROM r0)""",
    "item_knn": _with(VECTORS, "q AS (SELECT item_id AS query_id, e FROM vec)", _knn("q", 21, "near"))
    + "SELECT query_id AS item_id, item_id AS item_rec, round(score, 2) AS score FROM near WHERE query_id <> item_id",
    "item_knn_without_copies": _with(VECTORS, "q AS (SELECT item_id AS query_id, e FROM vec)", _knn("q", 21, "near"))
    + "SELECT query_id AS item_id, item_id AS item_rec, round(score, 2) AS score FROM near WHERE query_id <> item_id AND round(score, 2) <> 1",
    "search_items_vector": _with(VECTORS, CONTENTS,
                                 "q AS (SELECT CAST(k AS VARCHAR) AS query_id, e FROM contents JOIN vec ON item_id = k)",
                                 _knn("q", 20, "near"))
    + "SELECT query_id, item_id, round(score, 6) AS score, rank FROM near",
    "search_items_text": _with(
        CONTENTS, "q AS (SELECT DISTINCT p_name AS content FROM contents JOIN part ON p_partkey = k)",
        """parts AS (SELECT p_partkey AS item_id, p_name AS name, string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+') AS words FROM part)""",
        """hits AS (SELECT content, item_id, name, round(len(list_filter(words, lambda w: list_contains(
  string_split_regex(lower(content), '[^\\p{L}\\p{N}]+'), w))) / len(words), 6) AS score
  FROM q, parts WHERE list_has_all(words, string_split_regex(lower(content), '[^\\p{L}\\p{N}]+')))""")
    + """SELECT *, CAST(row_number() OVER (PARTITION BY content ORDER BY score DESC, item_id) AS INTEGER) AS rank
  FROM hits QUALIFY rank <= 3""",
    "text_weights": _with(_weights()) + "SELECT item_id, slot, round(weight, 6) AS weight FROM weights",
    "embed_text": _with(_weights()) + "SELECT item_id, slot, round(weight, 6) AS weight FROM weights",
    "upsert_items": _with(_weights()) + f"""
SELECT vec_id AS item_id, false AS is_new, CAST(unnest(range(len(embedding))) AS INTEGER) AS slot,
  round(unnest(CAST(embedding AS DOUBLE[])), 6) AS value FROM embeddings
UNION ALL SELECT d.item_id, true, s.slot, round(coalesce(weight, 0), 6)
  FROM docs d, (SELECT CAST(unnest(range({DIMS})) AS INTEGER) AS slot) s LEFT JOIN weights w ON w.item_id = d.item_id AND w.slot = s.slot
  WHERE d.item_id NOT IN (SELECT vec_id FROM embeddings)""",

    "sessions": _with(SESSIONS) + """SELECT session_id, user_id, created_at, count(action) AS n_actions,
  count(CASE WHEN event_type = 'signup' THEN 1 END) AS n_searches FROM ev GROUP BY ALL""",
    "recent_session_items": _with(SESSIONS, RECENT) + "SELECT *, count(*) AS times FROM recent GROUP BY ALL",
    "latest_searches": _with(SESSIONS, LATEST) + "SELECT * FROM latest",
    "rank_candidates": _with(*RANKED) + "SELECT user_id, item_id, round(score, 6) AS score, rank FROM ranked",
    "rank_candidates_ascending": _with(*RANKED[:-1], RANKED[-1].replace("ORDER BY score DESC", "ORDER BY score").replace("max(round", "min(round"))
    + "SELECT user_id, item_id, round(score, 6) AS score, rank FROM ranked",
    "exclude_rated": _with(*RANKED, R)
    + "SELECT user_id, item_id FROM ranked WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM r)",
    "split_rated": _with(*RANKED, R)
    + "SELECT user_id, item_id, (user_id, item_id) IN (SELECT (user_id, item_id) FROM r) AS rated FROM ranked",
    "recommend_from_sessions": _with(*RECOMMENDED) + "SELECT * FROM rec",
    "recommendation_payload": _with(*RECOMMENDED) + """SELECT user_id, '{"customer_id":"' || user_id || '","list":[' || string_agg(
  '{"product_id":"' || item_id || '","predict_rating":"' || prediction || '"}', ',' ORDER BY rank) || ']}' AS payload
  FROM rec GROUP BY user_id""",

    "new_ratings": _with(R0) + f"SELECT user_id, item_id, rating, ts, count(*) AS copies FROM r0 WHERE ts > {MARK_EPOCH} GROUP BY ALL",
    "append_new_ratings": _with(R0) + "SELECT user_id, count(*) AS n, max(ts) AS ts, sum(rating) AS total FROM r0 GROUP BY user_id",
    "changed_users": _with(R0, CHANGED) + "SELECT * FROM changed",
    "affected_clusters": _with(*CLUSTERED, CHANGED) + f"SELECT DISTINCT label FROM refined JOIN changed USING (user_id)",
    "mfps_incremental": _with(R, _sim("r"), CHANGED) + f"""SELECT {MFPS_COLUMNS} FROM s
  WHERE user_u IN (SELECT user_id FROM changed) OR user_v IN (SELECT user_id FROM changed)""",
    "mfps_incremental_few": _with(R, _sim("r"), "few AS (SELECT DISTINCT user_id FROM r WHERE ts = (SELECT max(ts) FROM r))")
    + f"SELECT {MFPS_COLUMNS} FROM s WHERE user_u IN (SELECT user_id FROM few) OR user_v IN (SELECT user_id FROM few)",
    "merge_similarity": _with(R, _sim("r")) + SCORES,
    "write_neighbours": _with(R, _sim("r")) + SCORES,
    "neighbours_of_user": _with(R, TOP, _sim("r")) + SCORES + " WHERE user_u = (SELECT user_id FROM top)",
    "write_similarity": _with(R, _sim("r")) + SCORES,

    "stream_ratings": _with(R0) + "SELECT DISTINCT user_id, item_id, rating, ts FROM r0",
    "stream_user_stats": _with(R0) + f"SELECT user_id, round(avg(rating), 6) AS avg_rating, {IMPORTANCE} FROM r0 GROUP BY user_id",
    "stream_similarity": _with(R, _sim("r")) + SCORES,
    "stream_sessions": _with(*STREAMED)
    + "SELECT user_id, created_at, ended_at, n_actions, round(weight, 6) AS weight FROM closed",
    "stream_recent_sessions": _with(*STREAMED) + """SELECT user_id, created_at, ended_at, n_actions, round(weight, 6) AS weight,
  user_id || '-' || created_at AS session_id FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY created_at DESC) AS k
  FROM closed) WHERE k <= 4""",
}
ORACLES["nearest_neighbours"] = ORACLES["neighbours_top_k"]
ORACLES["stream_similarity_changes"] = ORACLES["stream_similarity"]
ORACLES["search_items_fields"] = _with(
    CONTENTS, "stock AS (SELECT p_partkey AS item_id, p_name AS name, concat_ws(' ', p_brand, p_type) AS summary FROM part)",
    """q AS (SELECT DISTINCT unnest([name, string_split(name, ' ')[1], string_split(name, ' ')[-1], summary, string_split(summary, ' ')[-1]]) AS content
  FROM contents JOIN stock ON item_id = k)""",
    """texts AS (SELECT item_id, 'name' AS field, name AS t FROM stock UNION ALL SELECT item_id, 'summary', summary FROM stock)""",
    """fields AS (SELECT item_id, field, list_filter(string_split_regex(lower(t), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS words FROM texts)""",
    """asked AS (SELECT content, list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS a FROM q)""",
    """hits AS (SELECT content, item_id, field, round(len(list_filter(words, lambda w: list_contains(a, w))) / len(words), 6) AS score
  FROM asked, fields WHERE len(a) > 0 AND list_has_all(words, a))""",
    """best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY content, item_id ORDER BY score DESC, field) = 1)""") + """
SELECT *, CAST(row_number() OVER (PARTITION BY content ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM best QUALIFY rank <= 3"""
ORACLES["replace_neighbours"] = ORACLES["merge_similarity"]
