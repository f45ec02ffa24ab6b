"""Cumulative libraries across runs: observations of a run merged into the rows of earlier ones.

Prior rows and observations are joined by key (a full outer join) and written as a new snapshot; the ids behind a row
are kept as a long table of its own (``members``), so a community with a third of all posts is no long list.  A run
that is merged twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T

MENTION = r"(?i)(?:^|[^A-Za-z0-9_/])r/([A-Za-z0-9_]{2,21})"
#: How far a keyword's status has come.
STATUS = {"seed": 6, "active": 5, "approved": 5, "configured": 4, "formal": 4, "observed": 3, "candidate_review": 2, "weak_signal": 1, "rejected": 0}


def mentions(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a row for each community (lower case) that its text names as r/<name>."""
    return df.withColumn("community", F.explode_outer(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(MENTION), F.lit(1)), lambda x: F.lower(x))))).filter("community IS NOT NULL")


def in_domain(text: Column, anchors: list[str], excluded: list[str]) -> Column:
    """Whether a text holds an anchor anywhere and nothing excluded."""
    quoted = lambda ts: "|".join("".join(c if c.isalnum() or c == " " else "\\" + c for c in t) for t in ts) or "(?!)"
    low = F.lower(text)
    return low.rlike(quoted(anchors)) & ~low.rlike(quoted(excluded))


def community_members(observed: DataFrame) -> DataFrame:
    """key, kind ('post', 'author', 'relevant', 'run'), id: the distinct ids of observations.  ``observed``: key, post_id, author, relevant, run_id."""
    ids = F.array(F.struct(F.lit("post").alias("kind"), F.col("post_id").alias("id")), F.struct(F.lit("author").alias("kind"), F.col("author").alias("id")), F.struct(F.lit("relevant").alias("kind"), F.when(F.col("relevant"), F.col("post_id")).alias("id")), F.struct(F.lit("run").alias("kind"), F.col("run_id").alias("id")))
    return observed.select("key", F.explode(ids).alias("x")).select("key", "x.kind", "x.id").filter(F.trim("id") != "").distinct()


def merge_members(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two member tables; merging the same run again adds nothing."""
    return prior.unionByName(new).distinct()


def communities(prior: DataFrame, observed: DataFrame, members: DataFrame, seeds: list[str], name_ok: Column, least: int = 3) -> DataFrame:
    """key, status, counts.  ``prior``: key, status; ``observed`` of this run: key, off_domain; ``members``: merged.

    Seeds are 'seed'.  Others start 'observed' ('approved' ones by their name: observed or quarantined).  Any off-domain
    observation quarantines, for good; an observed one with enough posts, authors and relevant posts becomes active.
    Rows without observations keep their status.
    """
    now = observed.groupBy("key").agg(F.bool_or("off_domain").alias("off"))
    n = members.groupBy("key").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in ("post", "author", "relevant", "run")])
    j = prior.select(F.col("key"), F.lower("status").alias("was")).join(now, "key", "full_outer").join(n, "key", "left").fillna(0, ["n_post", "n_author", "n_relevant", "n_run"])
    p = F.when(F.col("was").isNull(), "observed").when(F.col("was") == "approved", F.when(name_ok, "observed").otherwise("quarantined")).otherwise(F.col("was"))
    ripe = (F.col("n_post") >= least) & (F.col("n_author") >= least) & (F.col("n_relevant") >= least)
    status = F.when(F.col("key").isin(seeds), "seed").when(F.col("off").isNull(), F.col("was")).when(F.col("off"), "quarantined").when((p == "observed") & ripe, "active").otherwise(p)
    return j.select("key", status.alias("status"), "n_post", "n_author", "n_relevant", "n_run")


def active_communities(rows: DataFrame, least: int = 3) -> DataFrame:
    """Keys the next run may read: seeds, and active ones with enough behind them."""
    ripe = (F.col("n_post") >= least) & (F.col("n_author") >= least) & (F.col("n_relevant") >= least)
    return rows.filter((F.col("status") == "seed") | ((F.col("status") == "active") & ripe)).select("key")


def _level(c: Column) -> Column:
    out = None
    for k, v in STATUS.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(1)


def keywords(prior: DataFrame, new: DataFrame, members: DataFrame, useful: Column) -> DataFrame:
    """term, status, score_max, author_max, counts.  ``prior`` and ``new``: term, status, score, n_authors; ``members``: term, kind ('post', 'run'), id, merged.

    The status that has come furthest wins (the earlier one of equals); two posts, two authors and a score of 20 make a
    keyword active unless it was rejected or quarantined; earlier rows that are no keywords are quarantined.
    """
    fold = lambda df: df.groupBy("term").agg(F.max_by(F.lower("status"), _level(F.lower("status"))).alias("status"), F.max("score").alias("score"), F.max("n_authors").alias("n_authors"))
    a = fold(prior).select("term", F.col("status").alias("was"), F.col("score").alias("score0"), F.col("n_authors").alias("authors0"))
    b = fold(new.filter(useful)).select("term", F.col("status").alias("now"), F.col("score").alias("score1"), F.col("n_authors").alias("authors1"))
    n = members.groupBy("term").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in ("post", "run")])
    j = a.join(b, "term", "full_outer").join(n, "term", "left").fillna(0, ["n_post", "n_run"])
    was = F.when(F.col("was").isNotNull() & ~useful, "quarantined").otherwise(F.coalesce("was", F.lit("observed")))
    x = j.withColumn("score_max", F.greatest("score0", "score1")).withColumn("author_max", F.greatest("authors0", "authors1"))
    best = F.when(F.col("now").isNull(), was).when(_level(F.col("now")) > _level(was), F.col("now")).otherwise(was)
    x = x.withColumn("s", best)
    ripe = F.col("now").isNotNull() & ~F.col("s").isin("rejected", "disabled", "quarantined") & (F.col("n_post") >= 2) & (F.col("author_max") >= 2) & (F.col("score_max") >= 20)
    return x.select("term", F.when(ripe, "active").otherwise(F.col("s")).alias("status"), "score_max", "author_max", "n_post", "n_run")


def topics(prior: DataFrame, new: DataFrame) -> DataFrame:
    """key, topic_id, label, status, maxima.  ``prior`` and ``new``: key, topic_id, label, status, n_posts, n_authors, heat; 'formal' stays, the latest label and post count win, author count and heat are the highest."""
    a = prior.select("key", *[F.col(c).alias(f"{c}_0") for c in ("topic_id", "label", "status", "n_posts", "n_authors", "heat")])
    b = new.select("key", *[F.col(c).alias(f"{c}_1") for c in ("topic_id", "label", "status", "n_posts", "n_authors", "heat")])
    j = a.join(b, "key", "full_outer")
    formal = (F.coalesce("status_0", F.lit("")) == "formal") | (F.coalesce("status_1", F.lit("")) == "formal")
    return j.select("key", F.coalesce("topic_id_0", "topic_id_1").alias("topic_id"), F.coalesce("label_1", "label_0").alias("label"), F.when(formal, "formal").otherwise("weak_signal").alias("status"), F.coalesce("n_posts_1", "n_posts_0").alias("n_posts_latest"), F.greatest("n_authors_0", "n_authors_1").alias("n_authors_max"), F.greatest("heat_0", "heat_1").alias("heat_max"))


def register(known: DataFrame, new: DataFrame) -> DataFrame:
    """Topic registry: earlier rows stay with their labels, new (community, key) pairs are added once with a computed id.  Both: community, key, label; of several new labels the first by ``ord``."""
    fresh = new.groupBy("community", "key").agg(F.min_by("label", "ord").alias("label")).join(known.select("community", "key"), ["community", "key"], "left_anti")
    return known.select("community", "key", "label").unionByName(fresh).withColumn("topic_id", T.topic_id(F.col("community"), F.col("key")))
