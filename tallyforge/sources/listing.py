"""Readers of saved raw files: listings, threads, reports, candidate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names under which providers deliver a field, the first that is there wins.
FIELDS = {
    "post_id": ("name", "id"),
    "url": ("permalink", "url"),
    "subreddit": ("subreddit", "subreddit_name_prefixed"),
    "title": ("title",),
    "body": ("selftext", "body"),
    "author": ("author",),
    "created": ("created_utc", "created_at"),
    "score": ("score", "ups", "upvotes"),
    "comment_count": ("num_comments", "comment_count", "comments"),
    "surface": ("source_surface",),
    "coverage_status": ("coverage_status",),
}


def _field(raw: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_variant_get(raw, f"$.{n}", "string") for n in names])


def raw_listings(spark: SparkSession, path: str) -> DataFrame:
    """file, raw: one row for each record of saved listing files (a list of objects, or an envelope data.children[].data).

    Files that are no JSON, and entries that are no objects, give a row with ``raw`` null and the text in ``rejected``.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    doc = text.withColumn("doc", F.try_parse_json("value"))
    rows = F.coalesce(F.try_variant_get("doc", "$.data.children", "array<variant>"), F.try_variant_get("doc", "$", "array<variant>"))
    each = doc.select("file", "value", F.explode_outer(rows).alias("entry"))
    inner = F.try_variant_get("entry", "$.data", "variant")
    raw = F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner).when(F.schema_of_variant("entry").startswith("OBJECT"), F.col("entry"))
    return each.select("file", raw.alias("raw"), F.when(raw.isNull(), F.col("value")).alias("rejected"))


def listing_rows(raw: DataFrame) -> DataFrame:
    """Records as rows with the columns that ``operators.listing.normalize`` takes; times from epoch seconds or ISO text."""
    from tallyforge.functions.text import parse_time

    c = {k: _field(F.col("raw"), v) for k, v in FIELDS.items()}
    surfaces = F.coalesce(F.try_variant_get("raw", "$.source_surfaces", "array<string>"), F.when(c["surface"].isNotNull(), F.array(c["surface"])))
    return raw.filter("raw IS NOT NULL").select("file", *[c[k].alias(k) for k in ("post_id", "url", "subreddit", "title", "body", "author")], parse_time(c["created"]).alias("created_at"), *[c[k].try_cast("long").alias(k) for k in ("score", "comment_count")], surfaces.alias("source_surfaces"), c["coverage_status"].alias("coverage_status"))


def raw_threads(spark: SparkSession, path: str) -> DataFrame:
    """file, ord, raw: the comments of saved thread files (a list, or an object with ``comments``)."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("doc"))
    rows = F.coalesce(F.try_variant_get("doc", "$.comments", "array<variant>"), F.try_variant_get("doc", "$", "array<variant>"))
    return text.select("file", F.posexplode(rows).alias("pos", "raw")).filter(F.schema_of_variant("raw").startswith("OBJECT")).select("file", (F.col("pos") + 1).alias("ord"), "raw")


def thread_rows(raw: DataFrame) -> DataFrame:
    """Comment rows with the columns that ``operators.threads.parse`` takes."""
    get = lambda *n: _field(F.col("raw"), n)
    post = F.concat(F.lit("t3_"), F.regexp_replace(F.regexp_extract("file", r"([^/]+)\.json$", 1), "^t3_", ""))
    return raw.select(post.alias("post_id"), "ord", get("comment_id", "id").alias("comment_id"), get("body").alias("body"), get("url", "permalink").alias("url"), get("author").alias("author"), get("parent_id").alias("parent_id"), get("depth").try_cast("int").alias("depth"), get("score").try_cast("long").alias("score"))


def report_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of multi-source reports for ``operators.overview.pool``: ranked candidates first, then each source's items."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("doc"))
    ranked = text.select("file", F.lit("").alias("group"), F.posexplode(F.try_variant_get("doc", "$.ranked_candidates", "array<variant>")).alias("pos", "raw"), F.lit(0).alias("part"))
    by = text.select("file", F.explode(F.try_variant_get("doc", "$.items_by_source", "map<string,array<variant>>")).alias("group", "items")).select("file", "group", F.posexplode("items").alias("pos", "raw"), F.lit(1).alias("part"))
    get = lambda *n: F.coalesce(*[F.nullif(F.trim(F.try_variant_get("raw", f"$.{x}", "string")), F.lit("")) for x in n])
    rows = ranked.unionByName(by)
    number = lambda *n: F.coalesce(*[F.nullif(F.try_variant_get("raw", f"$.{x}", "double"), F.lit(0.0)) for x in n], F.lit(0.0)).cast("long")
    order = F.struct("file", "part", "group", "pos")
    return rows.select(
        order.alias("ord"), F.lower(F.coalesce(get("source"), F.nullif("group", F.lit("")), F.lit("unknown"))).alias("source"), F.coalesce(get("item_id", "id"), F.col("pos").cast("string")).alias("item_id"), get("url", "source_url").alias("url"), get("title", "name", "source_title").alias("title"),
        get("excerpt_original", "snippet", "summary", "body").alias("excerpt"), get("published_at", "date", "created_at").alias("published"), get("author", "username", "creator").alias("author"), number("engagement", "score", "upvotes").alias("engagement"), number("comment_count", "num_comments", "comments").alias("comments"),
    )


def candidate_list(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of candidates with the post id taken from its url column."""
    df = spark.read.csv(path, header=True)
    return df.withColumn("post_id", F.concat(F.lit("t3_"), F.regexp_extract("url", r"/comments/([a-z0-9]+)", 1)))


def tolerant_json(text: Column) -> Column:
    """The JSON object in noisy output: the whole text, else from its first opening to its last closing brace; null where neither is one."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))


def gap_filled(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``first``, and those of ``second`` whose keys it lacks: saved rows win over ones rebuilt from raw files."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def unseen(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys that no earlier run finished: what a resumed run still has to do."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def latest(appended: DataFrame, key: str, seq: str) -> DataFrame:
    """The last write of each key of an append-only table."""
    cols = [c for c in appended.columns if c != key]
    return appended.groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("r")).select(key, *[F.col(f"r.{c}") for c in cols])
