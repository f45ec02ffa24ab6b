"""Listing rows: normalisation, merging of repeated deliveries, windows, rankings, samples and coverage."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import text as T

CURRENT_DAYS, BASELINE_DAYS = 30, 90
#: The words that make a post specific.
SPECIFIC = r"(?U)\b(?:fail(?:ed|ure)?|broken|leak|fitment|install|replace|repair|towing|haul|price|cost|which|help|problem|issue)\b"


def normalize(df: DataFrame, host: str = T.HOST) -> DataFrame:
    """Canonical columns of listing rows and ``reject``: why a row is no post, null for good ones.

    Rows without id, url, subreddit, title or time are kept with their reason, so that one bad row does not fail a batch.
    Null or blank author is null, null and negative counts are 0, null surfaces are an empty list.
    """
    c = F.col
    out = df.select(
        *[c(x) for x in df.columns if x in ("row_id", "batch_no", "received_at", "accepted_at")],
        T.post_id(c("post_id")).alias("post_id"), T.canonical_url(c("url"), host).alias("url"), T.blank_to_null(F.regexp_replace(T.collapse(c("subreddit")), "^/?[rR]/", "")).alias("subreddit"),
        T.blank_to_null(T.collapse(c("title"))).alias("title"), F.coalesce(F.trim(c("body")), F.lit("")).alias("body"), T.blank_to_null(T.collapse(c("author"))).alias("author"), c("created_at").cast("timestamp").alias("created_at"),
        T.non_negative(c("score")).alias("score"), T.non_negative(c("comment_count")).alias("comment_count"), F.coalesce(c("source_surfaces"), F.array().cast("array<string>")).alias("source_surfaces"),
    )
    why = F.when(c("post_id").isNull(), "missing_id").when(c("url").isNull(), "missing_url").when(c("subreddit").isNull(), "missing_subreddit").when(c("title").isNull(), "missing_title").when(c("created_at").isNull(), "missing_time")
    return out.withColumn("reject", why)


def accepted(normal: DataFrame) -> DataFrame:
    return normal.filter(F.col("reject").isNull()).drop("reject")


def fan_out(df: DataFrame, fallback: str) -> DataFrame:
    """One row for each surface of a record; ``fallback`` for those without."""
    own = F.filter("source_surfaces", lambda s: s.isNotNull() & (F.trim(s) != ""))
    return df.withColumn("surface", F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(fallback)))))


_RICH = ("body", "score", "comment_count", "url", "post_id", "title", "author", "created_at", "subreddit")


def _merge(df: DataFrame, key: str) -> DataFrame:
    """One row for each key: the one with the longest body (ties by all columns in a fixed order), the highest counts, all surfaces."""
    order = F.struct(F.length("body"), F.col("body"), F.col("score"), F.col("comment_count"), F.col("url"), F.col("post_id"), F.col("title"), F.coalesce("author", F.lit("")), F.col("created_at"), F.col("subreddit"))
    g = df.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*_RICH), order).alias("r"), F.max("score").alias("__s"), F.max("comment_count").alias("__c"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_surfaces")))).alias("source_surfaces"))
    return g.select(*[F.col(f"r.{c}") for c in _RICH if c not in ("score", "comment_count")], F.col("__s").alias("score"), F.col("__c").alias("comment_count"), "source_surfaces")


def dedup(df: DataFrame) -> DataFrame:
    """Merge by id, then by url, each partly on the map side.  Surfaces are a small fixed set, so their sets stay small."""
    return _merge(_merge(df.select(*_RICH, "source_surfaces"), "post_id"), "url")


def merge_first_wins(df: DataFrame, key: str, order: str, first: list[str], longest: str, highest: list[str], union: str) -> DataFrame:
    """One row for each key: ``first`` columns of the earliest row, the longest text (earliest of equals), the highest counts, the distinct values of ``union`` in order of appearance."""
    text = F.coalesce(F.col(longest), F.lit(""))
    size = lambda t, o: F.struct(-F.length(t), o)
    # A key may hold a third of all deliveries: first one row for each key and value, combined on the map side.
    each = df.groupBy(key, F.col(union).alias("__v")).agg(
        F.min(order).alias("__o"), F.min_by(F.struct(*first), order).alias("__f"), F.min_by(F.struct(text.alias("t"), F.col(order).alias("o")), size(text, F.col(order))).alias("__t"), *[F.max(c).alias(c) for c in highest]
    )
    g = each.groupBy(key).agg(
        F.min_by("__f", "__o").alias("__f"), F.min_by("__t.t", size(F.col("__t.t"), F.col("__t.o"))).alias(longest), *[F.max(c).alias(c) for c in highest],
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("__o").alias("o"), F.col("__v").alias("v")))), lambda x: x["v"]).alias(union),
    )
    return g.select(key, *[F.col(f"__f.{c}").alias(c) for c in first], longest, *highest, union)


def window_scope(created: Column, start: date, end: date) -> Column:
    """'current' up to 30 calendar days before ``end``, 'baseline' before that, null outside [start, end]."""
    day = F.to_date(created)
    return F.when(day.between(F.lit(start), F.lit(end)), F.when(F.datediff(F.lit(end), day) <= CURRENT_DAYS, "current").otherwise("baseline"))


def window_label(created: Column, as_of: datetime) -> Column:
    """'current' up to 30 days old, 'baseline' up to 90 (both inclusive), null for older and future ones."""
    t = F.lit(as_of)
    age = lambda d: created >= t - F.expr(f"INTERVAL {d} DAYS")
    return F.when(created > t, None).when(age(CURRENT_DAYS), "current").when(age(BASELINE_DAYS), "baseline")


def priority(window: Column, score: Column, comments: Column) -> Column:
    """60 for current posts, 0.3 for each of up to 100 votes, 0.1 for each of up to 100 comments, in hundredths as BIGINT."""
    return (F.when(window == "current", 6000).otherwise(0) + F.least(score, F.lit(100)) * 30 + F.least(comments, F.lit(100)) * 10).cast("bigint")


def _rank() -> list[Column]:
    return [F.col("priority").desc(), F.col("score").desc(), F.col("comment_count").desc(), F.col("post_id").asc()]


def top_k(df: DataFrame, k: int) -> DataFrame:
    """The k best posts of each community with their rank."""
    w = Window.partitionBy("community").orderBy(*_rank())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _heads(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group: a window group limit, so no task sorts a whole group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def month_round_robin(df: DataFrame, k: int) -> DataFrame:
    """``turn`` up to k: position when the months take turns, newest first, each giving its best post left."""
    heads = _heads(df.withColumn("month", F.date_format("created_at", "yyyy-MM")), ["community", "month"], _rank(), k)
    ranked = heads.withColumn("in_month", F.row_number().over(Window.partitionBy("community", "month").orderBy(*_rank())))
    return ranked.withColumn("turn", F.row_number().over(Window.partitionBy("community").orderBy("in_month", F.col("month").desc()))).filter(F.col("turn") <= k)


def half_even(x: float) -> int:
    return round(x)


def stratified(df: DataFrame, k: int) -> DataFrame:
    """At most k posts of each community in pick order: controversial ones, months in turn, specific ones, the best, fill.

    Each stage takes its quota of posts not yet taken, within the room left.  Only the first 2k posts of each order can
    be reached (at most k are taken before), so group limits cut the posts to a small pool first.
    """
    quotas = [max(1, half_even(k * 0.10)), max(1, half_even(k * 0.25)), max(1, half_even(k * 0.15)), max(0, half_even(k * 0.50)), k]
    text = F.lower(F.concat_ws(" ", "title", "body"))
    x = df.withColumn("month", F.date_format("created_at", "yyyy-MM")).withColumn("specificity", F.regexp_count(text, F.lit(SPECIFIC))).withColumn("controversial", F.array_contains("source_surfaces", "controversial"))
    words = [F.col("specificity").desc(), *_rank()]
    heads = [_heads(x, ["community"], _rank(), 2 * k), _heads(x, ["community", "month"], _rank(), 2 * k), _heads(x, ["community"], words, 2 * k), _heads(x.filter("controversial"), ["community"], _rank(), k)]
    pool = heads[0].unionByName(heads[1]).unionByName(heads[2]).unionByName(heads[3]).dropDuplicates(["community", "post_id"])
    pool = pool.withColumn("in_month", F.row_number().over(Window.partitionBy("community", "month").orderBy(*_rank())))
    by = Window.partitionBy("community")
    pool = pool.withColumn("turn", F.row_number().over(by.orderBy("in_month", F.col("month").desc()))).withColumn("rank", F.row_number().over(by.orderBy(*_rank()))).withColumn("by_words", F.row_number().over(by.orderBy(*words)))
    pool = pool.withColumn("by_dispute", F.when(F.col("controversial"), F.row_number().over(Window.partitionBy("community", "controversial").orderBy("rank"))))
    pick = F.lit(None).cast("int")
    taken = F.lit(0)
    pool = pool.withColumn("pick", pick).withColumn("taken", taken)
    for stage, (quota, order) in enumerate(zip(quotas, ["by_dispute", "turn", "by_words", "rank", "rank"], strict=True)):
        open_ = F.col("pick").isNull() & F.col(order).isNotNull()
        pool = pool.withColumn("next", F.when(open_, F.row_number().over(Window.partitionBy("community", open_).orderBy(order))))
        room = F.least(F.lit(quota), F.lit(k) - F.col("taken"))
        pool = pool.withColumn("pick", F.when(F.col("pick").isNotNull(), F.col("pick")).when(F.col("next") <= room, F.col("taken") + F.col("next")))
        pool = pool.withColumn("taken", F.count("pick").over(Window.partitionBy("community")).cast("int"))
        pool = pool.withColumn("stage", F.when(F.col("pick").isNotNull() & (F.col("stage").isNull() if stage else F.lit(True)), stage + 1).otherwise(F.col("stage") if stage else F.lit(None)))
    return pool.filter(F.col("pick").isNotNull())


def balanced(df: DataFrame, k: int) -> DataFrame:
    """At most k rows of each community: the newest, the oldest 'new' one, then top, controversial and hot in turn, then the rest by time."""
    quota = max(1, int(k * 0.7) - 1)
    new = F.array_contains("source_surfaces", "new")
    by = Window.partitionBy("community")
    recent = [F.col("created_at").desc(), F.col("post_id").asc()]
    is_kind = {"new": new, "top": F.exists("source_surfaces", lambda s: s.startswith("top")), "controversial": F.array_contains("source_surfaces", "controversial"), "hot": F.array_contains("source_surfaces", "hot")}
    heads = [_heads(df, ["community"], recent, 2 * k), _heads(df.filter(new), ["community"], [F.col("created_at").asc(), F.col("post_id").desc()], 1), *[_heads(df.filter(c), ["community"], recent, 2 * k) for c in is_kind.values()]]
    pool = heads[0]
    for h in heads[1:]:
        pool = pool.unionByName(h)
    x = pool.dropDuplicates(["community", "post_id"]).withColumn("all_pos", F.row_number().over(by.orderBy(*recent)))
    x = x.withColumn("new_pos", F.when(new, F.row_number().over(Window.partitionBy("community", new).orderBy(*recent)))).withColumn("new_last", F.max("new_pos").over(by))
    x = x.withColumn("pick", F.when(F.col("new_pos") <= F.least(F.lit(quota), F.lit(k)), F.struct(F.lit(1).alias("s"), F.col("new_pos").cast("int").alias("a"), F.lit(0).alias("b"))))
    x = x.withColumn("pick", F.coalesce("pick", F.when(F.col("new_pos") == F.col("new_last"), F.struct(F.lit(2).alias("s"), F.lit(0).alias("a"), F.lit(0).alias("b")))))
    free = F.col("pick").isNull()
    kind = F.when(free & F.exists("source_surfaces", lambda s: s.startswith("top")), 0).when(free & F.array_contains("source_surfaces", "controversial"), 1).when(free & F.array_contains("source_surfaces", "hot"), 2)
    x = x.withColumn("kind", kind).withColumn("kind_pos", F.when(F.col("kind").isNotNull(), F.row_number().over(Window.partitionBy("community", "kind").orderBy(*recent))))
    x = x.withColumn("pick", F.coalesce("pick", F.when(F.col("kind").isNotNull(), F.struct(F.lit(3).alias("s"), F.col("kind_pos").cast("int").alias("a"), F.col("kind").cast("int").alias("b"))), F.struct(F.lit(4).alias("s"), F.col("all_pos").cast("int").alias("a"), F.lit(0).alias("b"))))
    return x.withColumn("place", F.row_number().over(by.orderBy("pick", "post_id"))).filter(F.col("place") <= k)


def read_targets(candidates: DataFrame, done: DataFrame, k: int) -> DataFrame:
    """Posts still to read: not read yet, so many a community that those read and these are at most k."""
    have = done.groupBy("community").agg(F.count("*").alias("have"))
    todo = candidates.join(done.select("post_id"), "post_id", "left_anti").join(have, "community", "left")
    n = F.row_number().over(Window.partitionBy("community").orderBy(*_rank()))
    return todo.withColumn("n", n).filter(F.col("n") <= k).filter(F.col("n") + F.coalesce("have", F.lit(0)) <= k)  # the first is a group limit


def coverage(df: DataFrame, keys: list[str], start: date, hint: Column) -> DataFrame:
    """Dates, rows and status of each key: a hint 'partial' wins over 'complete', else complete if the first date reaches ``start``."""
    day = F.to_date("created_at")
    g = df.withColumn("__h", hint).groupBy(*keys).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n_rows"), F.bool_or(F.col("__h") == "partial").alias("p"), F.bool_or(F.col("__h") == "complete").alias("c"))
    status = F.when(F.col("p"), "partial").when(F.col("c"), "complete").when(F.col("first_day") <= F.lit(start), "complete").otherwise("partial")
    return g.select(*keys, "first_day", "last_day", "n_rows", status.alias("status"))


def run_status(cover: DataFrame) -> DataFrame:
    """One row: 'partial' with no rows or any that is not complete, else 'completed'."""
    return cover.agg(F.when((F.count("*") > 0) & F.bool_and(F.col("status") == "complete"), "completed").otherwise("partial").alias("status"))
