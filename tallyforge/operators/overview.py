"""Pools of evidence from several sources, references into them by alias, and the heat of samples."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T

ANONYMOUS = ("unknown", "未知", "anonymous", "匿名", "")


def pool(rows: DataFrame) -> DataFrame:
    """One row for each url (source and id where there is none): the longest texts (the earliest of equals), the highest counts, id and source of the first.

    ``rows``: ord (of any type that has an order), source, item_id, url, title, excerpt, published, author, engagement, comments.  Rows without title and
    excerpt are left out.
    """
    r = rows.filter((F.trim(F.coalesce("title", F.lit(""))) != "") | (F.trim(F.coalesce("excerpt", F.lit(""))) != ""))
    key = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("url:"), "url")).otherwise(F.concat_ws(":", F.lit("id"), "source", "item_id"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    g = r.groupBy(key.alias("k")).agg(
        F.min_by(F.struct("source", "item_id", "url"), "ord").alias("f"), *[F.min_by(text(c), F.struct(-F.length(text(c)), F.col("ord"))).alias(c) for c in ("title", "excerpt", "published", "author")], F.max("engagement").alias("engagement"), F.max("comments").alias("comments")
    )
    return g.select(F.concat_ws(":", "f.source", "f.item_id").alias("evidence_id"), "f.source", "f.item_id", F.coalesce("f.url", F.lit("")).alias("url"), "title", "excerpt", "published", "author", "engagement", "comments")


def aliases(pool_rows: DataFrame) -> DataFrame:
    """alias, evidence_id: an evidence id stands for itself; urls and item ids for the first row that has them."""
    own = pool_rows.select(F.col("evidence_id").alias("alias"), "evidence_id", F.lit(0).alias("p"))
    other = pool_rows.select(F.explode(F.array("url", "item_id")).alias("alias"), "evidence_id", F.lit(1).alias("p"))
    return own.unionByName(other).filter(F.coalesce("alias", F.lit("")) != "").groupBy("alias").agg(F.min(F.struct("p", "evidence_id")).alias("m")).select("alias", F.col("m.evidence_id").alias("evidence_id"))


def resolve(refs: DataFrame, alias_rows: DataFrame) -> DataFrame:
    """topic, evidence_id: the distinct rows of the pool that references name, with or without a slash at the end of a url."""
    a = refs.select("topic", "ref", F.regexp_replace("ref", "/+$", "").alias("bare"))
    one = a.join(alias_rows, F.col("ref") == F.col("alias"), "left").select("topic", "ref", "bare", "evidence_id")
    again = one.filter(F.col("evidence_id").isNull() & F.col("ref").startswith("http")).select("topic", "bare").join(alias_rows, F.col("bare") == F.col("alias")).select("topic", "evidence_id")
    return one.filter(F.col("evidence_id").isNotNull()).select("topic", "evidence_id").unionByName(again).distinct()


def split(resolved: DataFrame, least: int = 3) -> DataFrame:
    """topic, n_evidence, place: 'topics' with enough evidence, else 'watchlist'."""
    return resolved.groupBy("topic").agg(F.count("*").alias("n_evidence")).withColumn("place", F.when(F.col("n_evidence") >= least, "topics").otherwise("watchlist"))


def sample_heat(resolved: DataFrame, pool_rows: DataFrame, as_of: date, n_sources: int) -> DataFrame:
    """heat (0 to 100) of each topic from its evidence: number, engagement, sources and recency, the first two relative to the largest."""
    day = T.published_date(F.col("published"))
    recency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.greatest(F.lit(0), F.datediff(F.lit(as_of), day)) / 30))
    name = F.lower(F.trim(F.coalesce("author", F.lit(""))))
    g = resolved.join(pool_rows, "evidence_id").groupBy("topic").agg(
        F.count("*").alias("n"), F.sum(F.log1p(F.greatest(F.coalesce("engagement", F.lit(0)), F.lit(0)).cast("double"))).alias("e"), F.count_distinct("source").alias("n_sources"), F.coalesce(F.avg(recency), F.lit(0.0)).alias("r"), F.count_distinct(F.when(~name.isin(*ANONYMOUS), name)).alias("n_people")
    )
    top = g.agg(F.max("n").alias("top_n"), F.max("e").alias("top_e"))
    x = g.join(F.broadcast(top))  # one row
    score = 100 * (0.35 * F.col("n") / F.greatest("top_n", F.lit(1)) + 0.25 * F.when(F.col("top_e") > 0, F.col("e") / F.col("top_e")).otherwise(0.0) + 0.20 * F.col("n_sources") / F.lit(max(1, n_sources)) + 0.20 * F.col("r"))
    heat = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(score, 0).cast("int")))
    return x.select("topic", F.col("n").alias("n_evidence"), "n_sources", "n_people", heat.alias("heat"), F.when(heat >= 70, "high").when(heat >= 40, "medium").otherwise("low").alias("label"))


def overlay(base: DataFrame, richer: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with the non-blank values of ``richer`` in place of its own."""
    r = richer.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns])
    j = base.join(r, key, "left")
    return j.select(*[F.coalesce(T.blank_to_null(F.trim(f"__{c}")), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def labels(text: Column, lenses: list[tuple[str, str]], most: int = 3) -> Column:
    """The first ``most`` lenses (name, pattern) a text fits, else the last one."""
    hit = F.slice(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in lenses])), 1, most)
    return F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit(lenses[-1][0])))
