"""Comment threads: parsing with fallbacks, ranked flattening of reply trees, chunking by size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import text as T
from tallyforge.operators.hierarchy import comment_parent
from tallyforge.session import written

_CHUNKS = "post_id string, chunk int, n_comments int, size long"


def parse(comments: DataFrame, post_url: str = "post_url") -> DataFrame:
    """Comments with a body; id falls back to the position, url to the post's, depth to 1 or more, score to 0."""
    body = T.collapse(F.col("body"))
    x = comments.filter(F.col("body").isNotNull() & (body != ""))
    cid = F.coalesce(T.blank_to_null(F.trim("comment_id")), F.concat(F.lit("comment_"), F.col("ord").cast("string")))
    return x.select(
        "post_id", "ord", cid.alias("comment_id"), body.alias("body"), F.coalesce(T.blank_to_null(F.trim("url")), F.concat(F.col(post_url), F.lit("?comment="), cid)).alias("url"), F.coalesce("author", F.lit("")).alias("author"),
        comment_parent(F.col("parent_id")).alias("parent"), F.greatest(F.coalesce("depth", F.lit(1)), F.lit(1)).alias("depth"), F.coalesce("score", F.lit(0).cast("long")).alias("score"),
    )


def deliveries(comments: DataFrame) -> DataFrame:
    """One row a comment id: of several deliveries the last fetched (ties by score, position)."""
    cols = [c for c in comments.columns if c != "comment_id"]
    g = comments.groupBy("comment_id").agg(F.max_by(F.struct(*cols), F.struct(F.coalesce("fetched_at", F.timestamp_seconds(F.lit(0))), F.coalesce("score", F.lit(-1)), F.col("ord"))).alias("r"))
    return g.select("comment_id", *[F.col(f"r.{c}") for c in cols])


def flatten(comments: DataFrame, replies: int, levels: int) -> DataFrame:
    """The best ``replies`` comments of each parent by score (ties by position, then id), down to ``levels``, with a key in whose order they read in pre-order.

    ``comments``: post_id, comment_id, parent, ord, score.  Level by level, so the number of joins is ``levels``; ranks
    within a parent are group limits.
    """
    rank = F.row_number().over(Window.partitionBy("post_id", F.coalesce("parent", F.lit(""))).orderBy(F.col("score").desc(), F.col("ord").asc(), F.col("comment_id").asc()))
    kept = written(comments.withColumn("rank", rank).filter(F.col("rank") <= replies).select("post_id", "comment_id", "parent", "rank"), "ranked")
    key = F.lpad(F.col("rank").cast("string"), 5, "0")
    level = kept.filter("parent IS NULL").select("post_id", "comment_id", F.lit(1).alias("level"), key.alias("path"))
    out = level
    for n in range(2, levels + 1):
        up = level.select(F.col("post_id").alias("p"), F.col("comment_id").alias("up"), F.col("path").alias("before"))
        level = kept.join(up, (kept.post_id == up.p) & (kept.parent == up.up)).select("post_id", "comment_id", F.lit(n).alias("level"), F.concat_ws("/", "before", key).alias("path"))
        out = out.unionByName(level)
    return out


def chunks(comments: DataFrame, limit: int, overhead: int = 256) -> DataFrame:
    """Greedy chunks of each post's comments in order: a new one starts when the next comment would pass ``limit`` characters.

    Where a chunk starts depends on all before it, so a post's rows pass one task in order; only the running size is
    held, never the post's comments, and the sort spills.
    """
    size = (F.length(F.coalesce("body", F.lit(""))) + F.length(F.coalesce("url", F.lit(""))) + overhead).cast("long")
    rows = comments.select("post_id", "ord", "comment_id", size.alias("size"))
    n = int(comments.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post, chunk, count, total = None, 0, 0, 0
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            b = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], names=["post_id", "chunk", "n_comments", "size"])
            out.clear()
            return b

        for b in batches:
            for p, s in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if p != post or total + s > limit:
                    if count:
                        out.append((post, chunk, count, total))
                    chunk = chunk + 1 if p == post else 1
                    post, count, total = p, 0, 0
                count, total = count + 1, total + s
            if len(out) > 10_000:
                yield flush()
        if count:
            out.append((post, chunk, count, total))
        yield flush()

    return rows.repartition(n, "post_id").sortWithinPartitions("post_id", "ord", "comment_id").mapInArrow(run, _CHUNKS)


def fixed_chunks(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """``chunk``: groups of n rows in order."""
    return df.withColumn("chunk", F.expr(f"cast((row_number() OVER (PARTITION BY `{by}` ORDER BY `{order}`) - 1) div {n} AS int)"))


def commenters(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """post_id, name: distinct lower-case names of who commented, the post's author left out."""
    who = comments.select("post_id", F.lower("author").alias("name")).filter(F.trim("name") != "").distinct()
    op = posts.select(F.col("post_id").alias("p"), F.lower("author").alias("op"))
    return who.join(op, (who.post_id == op.p) & (who.name == op.op), "left_anti")
