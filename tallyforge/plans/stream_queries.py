"""Streaming and incremental queries over events and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import expansion
from tallyforge.session import new_path
from tallyforge.sources.listing import latest, unseen
from tallyforge.sources.tables import table
from tallyforge.streaming import events as S


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    return S.read(spark, folder, spark.read.parquet(f"{folder}/events.parquet").schema, "events.parquet")


def q_stream_windows(spark, folder):
    """Hourly counts of each type that the watermark has passed."""
    w = S.run_once(S.windows(_stream(spark, folder), "ts", "2 hours", "1 hour", ["event_type"]), name="windows")
    return w.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round(F.col("value") * 100).cast("long").alias("value100"))


def q_stream_dedup(spark, folder):
    d = S.run_once(S.deduplicated(_stream(spark, folder).withColumn("key", F.concat_ws("-", F.col("user_id").cast("string"), "event_type")), ["key"], "ts", "60 days"), name="dedup")
    return d.groupBy("event_type").agg(F.count("*").alias("n_keys"))


def q_stream_sessions(spark, folder):
    s = S.run_once(S.sessions(_stream(spark, folder), "ts", "1 hour", "6 hours", ["user_id"]), name="sessions")
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


def q_stream_upsert(spark, folder):
    """A keyed total kept up to date by micro-batches."""

    def merge(prior: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
        both = new if prior is None else prior.unionByName(new)
        return both.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    t = S.upsert_each(_stream(spark, folder), merge, new_path(spark, "totals"))
    return t.select("user_id", "n", F.unix_micros("last").alias("last"))


def q_expansion(spark, folder):
    """Terms reached from one seed by way of the posts that candidates name, and the round."""
    k = table(spark, folder, "keyword_candidates").select(T.blank_to_null(T.keyword_norm(F.col("normalized_term"))).alias("term"), F.explode(F.transform("source_post_ids", lambda x: T.post_id(x))).alias("post_id")).filter("term IS NOT NULL AND post_id IS NOT NULL").distinct()
    seed = spark.createDataFrame([("warranty claim",)], "term string")
    terms, _ = expansion.expand(seed, lambda t: k.join(t, "term", "left_semi"), lambda p: k.join(p, "post_id", "left_semi"))
    return terms.select("term", F.col("round").cast("long").alias("round"))


def q_latest(spark, folder):
    """Last write of each comment id in an append-only order of fetches."""
    c = table(spark, folder, "comments").select("comment_id", F.coalesce("score", F.lit(-1)).alias("score"), F.struct("fetched_at", F.coalesce("score", F.lit(-1)).alias("s"), "ord").alias("seq"))
    return latest(c, "comment_id", "seq").select("comment_id", "score")


def q_pending(spark, folder):
    """Posts of the batches that no earlier run has."""
    new = table(spark, folder, "post_batches").select(T.post_id(F.col("post_id")).alias("post_id")).filter("post_id IS NOT NULL").distinct()
    return unseen(new, table(spark, folder, "posts"), ["post_id"])


QUERIES = {f.__name__: f for f in (q_stream_windows, q_stream_dedup, q_stream_sessions, q_stream_upsert, q_expansion, q_latest, q_pending)}

_K = "k AS (SELECT DISTINCT term, post_id FROM (SELECT array_to_string(regexp_extract_all(lower(normalized_term), '[a-z0-9]+'), ' ') AS term, unnest(list_transform(source_post_ids, lambda x: CASE WHEN regexp_replace(lower(trim(x)), '^t3_', '') <> '' THEN 't3_' || regexp_replace(lower(trim(x)), '^t3_', '') END)) AS post_id FROM keyword_candidates) WHERE term <> '' AND post_id IS NOT NULL)"
ORACLE = {
    "q_stream_windows": "WITH m AS (SELECT max(ts) AS top FROM events) SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value) * 100)::BIGINT AS value100 FROM events, m WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= top - INTERVAL 2 HOUR GROUP BY 1, 2",
    "q_stream_dedup": "SELECT event_type, count(DISTINCT user_id) AS n_keys FROM events GROUP BY 1",
    "q_stream_upsert": "SELECT user_id, count(*) AS n, epoch_us(max(ts)) AS last FROM events GROUP BY 1",
    "q_expansion": "WITH RECURSIVE " + _K + ", walk(term, round) USING KEY (term) AS (SELECT 'warranty claim', 0::BIGINT UNION SELECT k2.term, min(w.round) + 1 FROM walk w JOIN k k1 ON k1.term = w.term JOIN k k2 ON k2.post_id = k1.post_id WHERE k2.term NOT IN (SELECT term FROM recurring.walk) GROUP BY 1) SELECT term, round FROM walk",
    "q_latest": "SELECT comment_id, arg_max(coalesce(score, -1), struct_pack(a := fetched_at, b := coalesce(score, -1), c := ord)) AS score FROM comments GROUP BY 1",
    "q_pending": "WITH n AS (SELECT DISTINCT CASE WHEN regexp_replace(lower(trim(post_id)), '^t3_', '') <> '' THEN 't3_' || regexp_replace(lower(trim(post_id)), '^t3_', '') END AS post_id FROM post_batches) SELECT post_id FROM n WHERE post_id IS NOT NULL AND post_id NOT IN (SELECT post_id FROM posts)",
}
