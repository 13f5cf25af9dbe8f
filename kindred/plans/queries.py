"""One runnable query per operator, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import schemas
from kindred.functions import scalar as fx
from kindred.operators import clustering, deltas, incremental, items, nearest, ratings as rt, recommend, search, sessions as ss, similarity
from kindred.plans import tables
from kindred.session import prepare, store, work_path
from kindred.sources import stores, text
from kindred.streaming import streams

CLUSTERS = 5
DIMS = 64
QUERIES = {}


def query(function):
    """Register under the function's name; the session settings are applied before it runs."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepare(spark), sf_dir)
    QUERIES[function.__name__] = run
    return run


def _round(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: fx.round_to(F.col(n), places) for n in names})


# --- ratings ---------------------------------------------------------------------------------

@query
def read_ratings(spark, d):
    return tables.ratings(spark, d).groupBy("user_id", "item_id", "rating", "ts").agg(F.count("*").alias("copies"))


@query
def ratings_dedup(spark, d):
    return rt.dedupe_ratings(tables.ratings(spark, d))


@query
def ratings_kv_roundtrip(spark, d):
    path = work_path(spark, "ratings-kv")
    text.write_ratings_kv(tables.ratings_dedup(spark, d), path)
    return text.read_ratings_kv(spark, path)


@query
def user_values_roundtrip(spark, d):
    path = work_path(spark, "averages")
    text.write_tsv(rt.avg_rating(tables.ratings_dedup(spark, d)), path)
    return _round(text.read_averages(spark, path), "avg_rating")


@query
def user_list(spark, d):
    return rt.user_list(tables.ratings(spark, d))


@query
def item_list(spark, d):
    return rt.item_list(tables.ratings(spark, d))


@query
def avg_rating(spark, d):
    return _round(rt.avg_rating(tables.ratings(spark, d)), "avg_rating")


@query
def importance(spark, d):
    return rt.importance(tables.ratings(spark, d))


@query
def items_per_user(spark, d):
    return rt.items_per_user(tables.ratings_dedup(spark, d))


@query
def top_user(spark, d):
    return rt.top_user(rt.importance(tables.ratings(spark, d)), "importance")


@query
def max_scale(spark, d):
    return _round(rt.max_scale(rt.importance(tables.ratings(spark, d)), "importance"), "scaled")


@query
def rating_total(spark, d):
    return rt.rating_total(tables.ratings(spark, d))


@query
def high_water_mark(spark, d):
    return rt.high_water_mark(tables.ratings(spark, d))


# --- similarity ------------------------------------------------------------------------------

@query
def corated_pairs(spark, d):
    return similarity.corated_pairs(tables.ratings_dedup(spark, d))


@query
def rating_commodity(spark, d):
    return similarity.rating_commodity(tables.ratings_dedup(spark, d))


@query
def rating_usefulness(spark, d):
    return similarity.rating_usefulness(tables.ratings_dedup(spark, d))


@query
def rating_details(spark, d):
    return similarity.rating_details(tables.ratings_dedup(spark, d))


@query
def rating_details_strict(spark, d):
    return similarity.rating_details(tables.ratings_dedup(spark, d), strict=True)


@query
def rating_time(spark, d):
    return _round(similarity.rating_time(tables.ratings_dedup(spark, d)), "rt")


@query
def mfps(spark, d):
    return _round(similarity.mfps(tables.ratings_dedup(spark, d)), "rt", "mfps")


@query
def combine_factors(spark, d):
    """Factors stored as flagged text, read back, gathered per pair and scored."""
    scored = similarity.mfps(tables.ratings_dedup(spark, d), keep="factors")
    paths = {f: work_path(spark, f) for f in ("rc", "ru", "rd", "rt")}
    for f, path in paths.items():
        text.write_pairs(scored, f, f, path)
    read = [text.read_pairs(spark, p).select("user_u", "user_v", F.col("value").alias(f)) for f, p in paths.items()]
    return _round(similarity.combine_factors(*read).select("user_u", "user_v", "mfps"), "mfps")


@query
def gather_factors(spark, d):
    """The four factors as one flagged relation, gathered per pair in one pass."""
    scored = similarity.mfps(tables.ratings_dedup(spark, d), keep="factors")
    path = work_path(spark, "factors")
    for f in ("rc", "ru", "rd", "rt"):
        text.write_pairs(scored, f, f, path, mode="append")
    return _round(text.pivot_factors(text.read_pairs(spark, path)), "rt")


def _scores(spark, d) -> DataFrame:
    return similarity.mfps(tables.ratings_dedup(spark, d)).select("user_u", "user_v", "mfps")


@query
def neighbours_top_k(spark, d):
    return _round(similarity.neighbours(_scores(spark, d), 50), "mfps")


@query
def nearest_neighbours(spark, d):
    """The same rows as `neighbours_top_k`, found by bounds."""
    return _round(nearest.nearest_neighbours(rt.dedupe_ratings(tables.ratings(spark, d)), 50), "mfps")


@query
def stranger_scores(spark, d):
    return _round(similarity.stranger_scores(tables.ratings_dedup(spark, d)), "stranger")


def _asked_pairs(clean) -> DataFrame:
    """Every user together with the most important one, common items or not."""
    top = rt.top_user(rt.importance(clean), "importance").select("user_id").scalar()
    return (rt.user_list(clean).select(F.col("user_id").alias("user_u"), top.alias("user_v"))
            .where("user_u <> user_v"))


@query
def similarity_of_zero(spark, d):
    clean = tables.ratings_dedup(spark, d)
    return _round(similarity.similarity_of(_asked_pairs(clean), similarity.mfps(clean), zero_rc="zero"), "mfps")


@query
def similarity_of_drop(spark, d):
    clean = tables.ratings_dedup(spark, d)
    return _round(similarity.similarity_of(_asked_pairs(clean), similarity.mfps(clean), zero_rc="drop"), "mfps")


@query
def similarity_of_skip(spark, d):
    clean = tables.ratings_dedup(spark, d)
    return _round(similarity.similarity_of(_asked_pairs(clean), similarity.mfps(clean), clean, zero_rc="skip"), "mfps")


# --- prediction, recommendation, evaluation ---------------------------------------------------

def _predictions(spark, d, **kw):
    train, test = tables.train_test(spark, d)
    return recommend.predict_from_halves(test, train, similarity.half_scores(train), **kw), train, test


@query
def predict_ratings(spark, d):
    return _round(_predictions(spark, d)[0], "prediction")


@query
def predict_ratings_offline(spark, d):
    """The offline variant: at most 5, and -1 for items without similar raters."""
    return _round(_predictions(spark, d, fallback=-1, bounds=(None, 5))[0], "prediction")


@query
def recommend_top_n(spark, d):
    return _round(recommend.recommend_top_n(_predictions(spark, d)[0], 5), "prediction")


@query
def evaluate_ranking(spark, d):
    predicted, train, test = _predictions(spark, d)
    return _round(recommend.evaluate_ranking(predicted, test, rt.avg_rating(train), 5, with_lists=True),
                  "precision", "recall", "f1")


@query
def evaluate_user_range(spark, d):
    """Ranking quality of the users 100 to 600 that the training data holds."""
    predicted, train, test = _predictions(spark, d)
    predicted, test = (recommend.for_users(x, 100, 600, train) for x in (predicted, test))
    return _round(recommend.evaluate_ranking(predicted, test, rt.avg_rating(train), 5, with_lists=True),
                  "precision", "recall", "f1")


@query
def rating_errors(spark, d):
    predicted, _, test = _predictions(spark, d)
    return _round(recommend.rating_errors(predicted, test), "prediction", "sq_err")


@query
def evaluate_rating_error(spark, d):
    predicted, _, test = _predictions(spark, d)
    return _round(recommend.evaluate_rating_error(predicted, test), "rmse", "mae")


# --- clustering ------------------------------------------------------------------------------

@query
def user_profile(spark, d):
    return _round(rt.user_profile(tables.ratings_dedup(spark, d)), "base", "dev")


def _cell_sums(cells: DataFrame, *keys: str) -> DataFrame:
    item, value = F.col("item_id"), F.col("value")
    return cells.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.round(F.sum(value), 4).alias("sum_value"),
                                    F.round(F.sum(value * item) / F.sum(item + 1), 4).alias("mean_by_item"))


@query
def dense_matrix(spark, d):
    """The full matrix, checked through sums per user and block."""
    # No block is empty; told so, Spark does not make the cells once more to find out.
    cells = rt.dense_matrix(tables.ratings_dedup(spark, d)).select("user_id", "block", F.inline_outer("cells"))
    return _cell_sums(cells, "user_id", "block")


@query
def packed_matrix_roundtrip(spark, d):
    """The full mean-filled matrix as text labelled by cluster, and back."""
    clean = tables.ratings_dedup(spark, d)
    path = work_path(spark, "packed")
    text.write_packed_matrix(rt.dense_matrix(clean), path, _labels(clean))
    return _round(text.read_packed_matrix(spark, path), "value")


def _first_seed(spark, d):
    clean = tables.ratings_dedup(spark, d)
    profile = clustering.prepare_profile(clean)
    f = rt.importance(clean)
    seed = rt.top_user(f, "importance").select(F.lit(0).alias("ordinal"), F.col("user_id").alias("label"))
    return profile, f, clustering.pick_centroid(profile, seed)


@query
def pick_centroid(spark, d):
    return _round(_first_seed(spark, d)[2].drop("ordinal"), "base", "dev")


@query
def distance_to_centroid(spark, d):
    profile, _, seed = _first_seed(spark, d)
    return _round(clustering.distance_to_centroid(profile, seed), "distance", places=5)


def _near_first(spark, d):
    profile, f, seed = _first_seed(spark, d)
    distances = clustering.distance_to_centroid(profile, seed)
    n = f.count()
    return distances, f, clustering.m_nearest(distances, clustering.nearest_count(n, CLUSTERS))


@query
def m_nearest(spark, d):
    return _round(_near_first(spark, d)[2], "distance", places=5)


@query
def discard_users(spark, d):
    _, f, near = _near_first(spark, d)
    return clustering.discard_users(f, near)


@query
def seed_score(spark, d):
    distances, f, near = _near_first(spark, d)
    rest = clustering.discard_users(f, near).join(distances, "user_id")
    largest = float(f.agg(F.max("importance")).first()[0])
    return _round(clustering.seed_score(rest, largest).select("user_id", "importance", "distance", "score"),
                  "distance", "score", places=5)


def _seeding(clean, f_scale: str = "global"):
    profile = clustering.prepare_profile(clean)
    return profile, clustering.seed_centroids(profile, rt.importance(clean), CLUSTERS, f_scale)


@query
def seed_centroids(spark, d):
    return _round(_seeding(tables.ratings_dedup(spark, d))[1].seeds, "score", places=5)


@query
def seed_centroids_pool(spark, d):
    return _round(_seeding(tables.ratings_dedup(spark, d), "pool")[1].seeds, "score", places=5)


@query
def seed_labels(spark, d):
    profile, seeding = _seeding(tables.ratings_dedup(spark, d))
    return clustering.seed_labels(seeding, profile).select("user_id", "label")


@query
def assign_clusters(spark, d):
    profile, seeding = _seeding(tables.ratings_dedup(spark, d))
    found = clustering.assign_clusters(profile, seeding.centroids)
    return _round(found.select("user_id", "label", "distance"), "distance", places=5)


@query
def update_centroids(spark, d):
    profile, seeding = _seeding(tables.ratings_dedup(spark, d))
    moved = clustering.update_centroids(profile, clustering.assign_clusters(profile, seeding.centroids))
    # back to the dense mean: absent cells hold the base
    return _round(moved.select("label", "item_id", (F.col("base") + F.col("dev")).alias("value")), "value", places=5)


@query
def refine_clusters(spark, d):
    profile, seeding = _seeding(tables.ratings_dedup(spark, d))
    found, _, _ = clustering.refine_clusters(profile, seeding.centroids)
    return _round(found.select("user_id", "label", "distance"), "distance", places=5)


def _labels(clean) -> DataFrame:
    profile, seeding = _seeding(clean)
    return clustering.labels(clustering.refine_clusters(profile, seeding.centroids)[0])


@query
def avg_rating_by_label(spark, d):
    clean = tables.ratings_dedup(spark, d)
    return _round(rt.avg_rating_by_label(clean, _labels(clean)), "avg_rating")


@query
def write_labels(spark, d):
    path = work_path(spark, "labels")
    stores.write_labels(_labels(tables.ratings_dedup(spark, d)), path)
    return spark.read.parquet(path)


@query
def write_clusters(spark, d):
    path = work_path(spark, "clusters")
    clean = tables.ratings_dedup(spark, d)
    stores.write_clusters(clean, _labels(clean), path)
    return _round(stores.read_clusters(spark, path), "avg_rating")


@query
def mfps_within_cluster(spark, d):
    clean = tables.ratings_dedup(spark, d)
    labelled = clustering.label_ratings(clean, _labels(clean))
    return _round(similarity.mfps(labelled, within="label"), "rt", "mfps")


# --- items -----------------------------------------------------------------------------------

@query
def extract_item_id(spark, d):
    keys = tables.items(spark, d).select(F.concat(F.lit("ecommerce:product:"), F.col("item_id")).alias("key"))
    others = tables.items(spark, d).select(F.concat(F.lit("ecommerce:sim:"), F.col("item_id")).alias("key"))
    return items.extract_item_id(keys.unionByName(others))


@query
def item_embeddings(spark, d):
    wanted = rt.item_list(tables.ratings(spark, d))
    found = items.item_embeddings(wanted, tables.items(spark, d))
    return found.select("item_id", F.size("embedding").alias("n_dims"),
                        F.round(fx.norm(F.col("embedding")), 5).alias("length"))


@query
def item_knn(spark, d):
    return items.item_knn(tables.items(spark, d))


@query
def item_knn_without_copies(spark, d):
    return items.item_knn(tables.items(spark, d), drop_exact=True)


def _contents(spark, d):
    return tables.session_tables(spark, d)[2].select("content").distinct()


def _content_vectors(spark, d):
    stock = tables.items(spark, d)
    return lambda contents: (contents.join(stock, F.col("item_id").cast("string") == F.col("content"))
                             .select("content", F.col("embedding").alias("vector")))


@query
def search_items_vector(spark, d):
    queries = _content_vectors(spark, d)(_contents(spark, d)).withColumnRenamed("content", "query_id")
    return _round(items.search_items_vector(queries, tables.items(spark, d), 20), "score")


@query
def search_items_text(spark, d):
    """Searches by name: the content is the name of the part that the event points to."""
    parts = tables.named_items(spark, d)
    asked = (_contents(spark, d).join(parts, F.col("item_id").cast("string") == F.col("content"))
             .select(F.col("name").alias("content")))
    return items.search_items_text(asked, parts, 3)


@query
def search_items_fields(spark, d):
    """Searches by whole names, parts of names, brands and kinds over two fields of a stored index."""
    path, parts = work_path(spark, "index"), tables.described_items(spark, d)
    search.build_index(parts, path)
    named = _contents(spark, d).join(parts, F.col("item_id").cast("string") == F.col("content"))
    texts = F.array("name", F.split("name", " ")[0], F.element_at(F.split("name", " "), -1), "summary", F.element_at(F.split("summary", " "), -1))
    return search.search_index(spark, path, named.select(F.explode(texts).alias("content")), 3)


@query
def text_weights(spark, d):
    return _round(items.text_weights(tables.documents(spark, d), DIMS), "weight")


@query
def embed_text(spark, d):
    found = items.embed_text(tables.documents(spark, d), DIMS)
    return (found.select("item_id", F.posexplode("embedding").alias("slot", "weight")).where("weight <> 0")
            .withColumn("weight", F.round("weight", 6)))


@query
def upsert_items(spark, d):
    path = work_path(spark, "items")
    tables.items(spark, d).select("item_id", F.col("embedding").cast("array<double>")).write.parquet(path)
    known = spark.read.parquet(path).select("item_id", F.lit(False).alias("is_new"))
    known = store(known, "known")
    items.append_items(spark, path, tables.documents(spark, d), dims=DIMS)
    found = spark.read.parquet(path).join(known, "item_id", "left").withColumn("is_new", F.coalesce("is_new", F.lit(True)))
    return _round(found.select("item_id", "is_new", F.posexplode("embedding").alias("slot", "value")), "value")


# --- sessions --------------------------------------------------------------------------------

@query
def sessions(spark, d):
    found, activity, searches = tables.session_tables(spark, d)
    count = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias(name))
    return (found.join(count(activity, "n_actions"), "session_id", "left")
            .join(count(searches, "n_searches"), "session_id", "left").fillna(0))


@query
def recent_session_items(spark, d):
    found, activity, _ = tables.session_tables(spark, d)
    return (ss.recent_session_items(found, activity).groupBy("user_id", "session_id", "created_at", "item_id", "weight")
            .agg(F.count("*").alias("times")))


@query
def latest_searches(spark, d):
    found, _, searches = tables.session_tables(spark, d)
    return ss.latest_searches(found, searches)


def _ranked(spark, d, order: str = "desc"):
    found, activity, searches = tables.session_tables(spark, d)
    stock = tables.items(spark, d)
    asked = store(ss.latest_searches(found, searches).select("user_id", "content"), "asked")
    queries = store(_content_vectors(spark, d)(asked.select("content").distinct()).withColumnRenamed("content", "query_id"), "queries")
    hits = items.search_items_vector(queries, stock, 20).select(F.col("query_id").alias("content"), "item_id")
    return ss.rank_candidates(ss.recent_session_items(found, activity), asked.join(hits, "content"), stock, order=order)


@query
def rank_candidates(spark, d):
    return _round(_ranked(spark, d), "score")


@query
def rank_candidates_ascending(spark, d):
    return _round(_ranked(spark, d, "asc"), "score")


@query
def exclude_rated(spark, d):
    return ss.exclude_rated(_ranked(spark, d).select("user_id", "item_id"), tables.ratings_dedup(spark, d))


@query
def split_rated(spark, d):
    return ss.split_rated(_ranked(spark, d).select("user_id", "item_id"), tables.ratings_dedup(spark, d))


def _recommended(spark, d):
    found, activity, searches = tables.session_tables(spark, d)
    clean = tables.ratings_dedup(spark, d)
    # only users with candidates are asked for, so only their pairs are scored
    scores = lambda users: incremental.mfps_incremental(clean, users).select("user_u", "user_v", "mfps")
    return ss.recommend_from_sessions(found, activity, searches, tables.items(spark, d), _content_vectors(spark, d),
                                      clean, scores)


@query
def recommend_from_sessions(spark, d):
    return _round(_recommended(spark, d), "prediction")


@query
def recommendation_payload(spark, d):
    return ss.recommendation_payload(_round(_recommended(spark, d), "prediction"))


# --- incremental -----------------------------------------------------------------------------

def _stored_and_reviews(spark, d):
    everything = tables.ratings(spark, d)
    return everything.where(F.col("ts") <= tables.MARK_EPOCH), everything


@query
def new_ratings(spark, d):
    stored, reviews = _stored_and_reviews(spark, d)
    return incremental.new_ratings(reviews, stored).groupBy("user_id", "item_id", "rating", "ts").agg(
        F.count("*").alias("copies"))


@query
def append_new_ratings(spark, d):
    stored, reviews = _stored_and_reviews(spark, d)
    return incremental.append_new_ratings(stored, reviews).groupBy("user_id").agg(
        F.count("*").alias("n"), F.max("ts").alias("ts"), F.sum("rating").alias("total"))


def _changed(spark, d):
    stored, reviews = _stored_and_reviews(spark, d)
    return incremental.changed_users(incremental.new_ratings(reviews, stored))


@query
def changed_users(spark, d):
    return _changed(spark, d)


@query
def affected_clusters(spark, d):
    return incremental.affected_clusters(_changed(spark, d), _labels(tables.ratings_dedup(spark, d)))


@query
def mfps_incremental(spark, d):
    return _round(incremental.mfps_incremental(tables.ratings_dedup(spark, d), _changed(spark, d)), "rt", "mfps")


@query
def mfps_incremental_few(spark, d):
    """Only the users of the newest ratings changed."""
    clean = tables.ratings_dedup(spark, d)
    newest = clean.where(F.col("ts") == clean.agg(F.max("ts")).scalar())
    return _round(incremental.mfps_incremental(clean, incremental.changed_users(newest)), "rt", "mfps")


@query
def merge_similarity(spark, d):
    """Stored scores of the older ratings, refreshed for changed users: equal to a full recompute."""
    clean = tables.ratings_dedup(spark, d)
    train = clean.where(F.col("ts") <= tables.MARK_EPOCH)
    changed = _changed(spark, d)
    fresh = incremental.mfps_incremental(clean, changed)
    return _round(incremental.merge_similarity(similarity.mfps(train), fresh, changed), "mfps")


@query
def replace_neighbours(spark, d):
    """Stored neighbour folders of the older ratings, those that changed users touch replaced: equal to a full recompute."""
    path, clean = work_path(spark, "neighbours"), tables.ratings_dedup(spark, d)
    homes = stores.homes_of(clean)
    stores.write_neighbours(similarity.mfps_by_user(clean.where(F.col("ts") <= tables.MARK_EPOCH), homes), path, dealt=True)
    changed = _changed(spark, d)
    stores.replace_neighbours(incremental.mfps_incremental_by_user(clean, changed, homes), changed, path, dealt=True)
    return _round(stores.read_neighbours(spark, path), "mfps")


@query
def write_neighbours(spark, d):
    path = work_path(spark, "neighbours")
    clean = tables.ratings_dedup(spark, d)
    stores.write_neighbours(similarity.mfps_by_user(clean, stores.homes_of(clean)), path, dealt=True)
    return _round(stores.read_neighbours(spark, path), "mfps")


@query
def neighbours_of_user(spark, d):
    """The stored scores of the most important user, read from that user's folder."""
    path, clean = work_path(spark, "neighbours"), tables.ratings_dedup(spark, d)
    stores.write_neighbours(similarity.mfps_by_user(clean, stores.homes_of(clean)), path, dealt=True)
    user = rt.top_user(rt.importance(clean), "importance").first()["user_id"]
    return _round(stores.read_neighbours(spark, path, user=user), "mfps")


@query
def write_similarity(spark, d):
    path = work_path(spark, "similarity")
    stores.write_similarity(schemas.empty(spark, schemas.SIMILARITY), path, "overwrite")
    stores.write_similarity(_scores(spark, d), path)
    return _round(spark.read.parquet(path), "mfps")


# --- streams ---------------------------------------------------------------------------------

BATCHES = 4


def _file_count(df: DataFrame) -> int:
    """Files per micro-batch: as many as the source's tasks, shared by the batches."""
    return max(1, -(-df.rdd.getNumPartitions() // BATCHES))


def _rating_stream(spark, ratings: DataFrame) -> DataFrame:
    """The ratings as a stream of several micro-batches, each with ratings of all times."""
    path, files = work_path(spark, "incoming"), _file_count(ratings)
    ratings.repartition(BATCHES * files, "user_id").write.parquet(path)
    return streams.read_stream(spark, path, schemas.RATINGS, files_per_batch=files)


@query
def stream_ratings(spark, d):
    sink = work_path(spark, "stream-ratings")
    stream = _rating_stream(spark, tables.ratings(spark, d))
    streams.stream_ratings(stream, sink, work_path(spark, "state")).awaitTermination()
    return streams.stored_ratings(spark, sink)


@query
def stream_user_stats(spark, d):
    sink = work_path(spark, "stream-stats")
    stream = _rating_stream(spark, tables.ratings(spark, d))
    streams.stream_user_stats(stream, sink, work_path(spark, "state")).awaitTermination()
    found = streams.latest_user_stats(spark, sink)
    return _round(found.select("user_id", "avg_rating", F.col("importance").cast("bigint").alias("importance")), "avg_rating")


@query
def stream_similarity(spark, d):
    """Older ratings stored, later ones streamed in: ends equal to a full recompute."""
    sink = work_path(spark, "stream-similarity")
    train, test = tables.train_test(spark, d)
    stream = _rating_stream(spark, test)
    base = similarity.mfps(train).select("user_u", "user_v", "mfps")
    streams.stream_similarity(stream, train, base, sink, work_path(spark, "state")).awaitTermination()
    return _round(streams.current_similarity(spark, sink), "mfps")


@query
def stream_similarity_changes(spark, d):
    """As `stream_similarity`, kept by signed changes of the stored factors."""
    sink = work_path(spark, "stream-changes")
    train, test = tables.train_test(spark, d)
    streams.stream_similarity_changes(_rating_stream(spark, test), train, sink, work_path(spark, "state")).awaitTermination()
    return _round(deltas.current_scores(spark, sink).select("user_u", "user_v", "mfps"), "mfps")


def _activity_stream(spark, d) -> DataFrame:
    """The events as a stream of several micro-batches, in order of time."""
    stored, path = tables.table(spark, d, "events"), work_path(spark, "incoming-events")
    files = _file_count(stored)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = stored.select(at.alias("at")).approxQuantile("at", [k / BATCHES for k in range(1, BATCHES)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = stored.where(F.lit(True) if low is None else at >= int(low)).where(F.lit(True) if high is None else at < int(high))
        part.repartition(files, "user_id").write.mode("append").parquet(path)
    raw = streams.read_stream(spark, path, stored.schema, files_per_batch=files)
    return tables.activity_of(tables.shape_events(raw)).select(
        "user_id", "action", F.timestamp_micros("ts").alias("event_time"))


@query
def stream_sessions(spark, d):
    sink = work_path(spark, "stream-sessions")
    streams.stream_sessions(_activity_stream(spark, d), sink, work_path(spark, "state")).awaitTermination()
    return _round(spark.read.parquet(sink).drop("batch"), "weight")


@query
def stream_recent_sessions(spark, d):
    sink = work_path(spark, "stream-recent")
    streams.stream_recent_sessions(_activity_stream(spark, d), sink, work_path(spark, "state")).awaitTermination()
    return _round(streams.latest_sessions(spark, sink), "weight")
