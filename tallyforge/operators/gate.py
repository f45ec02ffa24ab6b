"""Rule cascade over records: exclusion reasons, duplicates in order, feature flags, component scores and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions.vocabulary import Lexicon
from tallyforge.operators import skew
from tallyforge.session import written

#: The patterns behind the flags.
FLAGS = {
    "first_person": r"\b(?:i|my|we|our)\b",
    "practitioner": r"\b(?:mechanic|technician|diesel tech|shop)\b",
    "context": r"\b(?:tow|towing|haul|hauling|daily driv|work truck|off[ -]?road|winter|cold)\w*\b",
    "vehicle": r"\b(?:19|20)\d{2}\b|\b(?:ram|super duty|f[ -]?250|f[ -]?350|silverado|sierra)\b",
    "outcome": r"\b(?:fail|failed|leak|leaked|crack|cracked|seep|fixed|fix|broke|broken|overheat|fit|didn.t fit)\w*\b",
    "purchase": r"\b(?:buy|bought|purchase|price|cost|under \$|order|return|returned|replace|replaced)\w*\b",
    "completed": r"\b(?:bought|purchased|ordered|installed|replaced|returned)\b",
    "diagnostic": r"\b(?:code|dtc|diagnos|scan|clamp|sensor|pressure|temperature|torque|install)\w*\b",
    "demand": r"\b(?:need|looking for|what should i|get me|recommend)\b|\bwhich\b.{0,40}\bshould i\b",
    "market": r"\b(?:owners?|users?|people)\s+(?:report|describe|mention|say)\b|\baftermarket options?\b",
}
PROMOTION = ("coupon", "promo code", "discount code", "affiliate", "use code", "buy now", "free shipping")
ADVERT = r"\b(?:coupon|promo code|discount code|affiliate|buy now|free shipping)\b"
ROLES = ("direct_experience", "qualified_practitioner", "contextual_demand", "market_observation", "weak", "noise")


def flags(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``df`` (record_type, ord, author, community, title, body, score) with text, norm, flags, hits, and ``hard``: the first reason that excludes a record, but for duplicates."""
    parts = [F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c)) for c in (F.col("title"), F.col("body"))]
    x = df.withColumn("text", F.concat_ws("\n", *parts)).withColumn("lower", F.lower("text")).withColumn("norm", T.evidence_norm(F.col("text")))
    low = F.col("lower")
    x = x.withColumns({k: low.rlike(p) for k, p in FLAGS.items()})
    any_hit = lambda t: low.rlike(T.any_of(t))
    x = x.withColumns({"product_hit": any_hit(lexicon.products), "platform_hit": any_hit(lexicon.platforms), "vehicle_hit": any_hit(lexicon.vehicle_terms)})
    author, where = F.lower(F.coalesce("author", F.lit(""))), F.lower(F.coalesce("community", F.lit("")))
    x = x.withColumn("approved", where.isin([c.lower() for c in lexicon.approved_communities]))
    hard = (
        F.when((author == "automoderator") | author.rlike("(?:^|[_-])bot(?:$|[_-])"), "bot_author")
        .when(F.col("text").rlike(r"(?i)^\s*\[(?:deleted|removed)\]\s*$"), "deleted_or_removed")
        .when(F.trim("text").rlike(r"(?i)^https?://\S+$"), "url_only")
        .when(low.rlike(T.any_of((*lexicon.promotional, *PROMOTION))), "promotion")
        .when(F.col("text").rlike(r"(?i)^\s*(?:same|this|lol|lmao|nice|agreed|following|bump)\s*[.!?]*\s*$"), "banter")
        .when(any_hit(lexicon.off_domain) | where.isin([c.lower() for c in lexicon.excluded_communities]), "off_domain")
    )
    words = F.when(F.col("norm") == "", 0).otherwise(F.size(F.split("norm", " ")))
    x = x.withColumns({"short": words < 8, "advert": low.rlike(ADVERT), "quoted": F.ltrim("text").rlike("^[\"']")})
    x = x.withColumn("hard", hard).withColumn("in_domain", F.col("approved") | F.col("platform_hit") | F.col("vehicle_hit"))
    return x.withColumn("registers", F.col("hard").isNull() & F.col("in_domain"))


def first_uses(flagged: DataFrame) -> DataFrame:
    """record_type, norm, first_ord: the first scored record of each text.  Combined on the map side, so that a text that is a third of all rows is one row a task."""
    return flagged.filter(F.col("registers") & (F.col("norm") != "")).groupBy("record_type", "norm").agg(F.min("ord").alias("first_ord"))


def reasons(flagged: DataFrame) -> DataFrame:
    """With ``reason``: hard, else duplicate of an earlier scored record, else out of domain, else null.

    The texts have done their part: without them, and with a digest for the normalised text, the records are written
    once, so that the patterns run once and the join moves a few bytes a record.
    """
    narrow = flagged.drop("text", "lower", "title", "body").withColumn("norm", F.when(F.col("norm") != "", F.md5("norm")).otherwise(""))
    x = written(narrow, "flags")
    # A viral text may be a third of all records, the empty one more: the empty one matches nothing, hot ones stay where they are.
    x = x.withColumn("use", F.when(F.col("norm") != "", F.concat_ws("|", "record_type", "norm")))
    first = first_uses(x).select(F.concat_ws("|", "record_type", "norm").alias("__use"), "first_ord")
    x = skew.join(x, first, "use", "__use", skew.hot_keys(x, "use"), how="left", nulls=True).drop("use", "__use")
    dup = F.col("hard").isNull() & (F.col("norm") != "") & (F.col("first_ord") < F.col("ord"))
    return x.withColumn("reason", F.when(F.col("hard").isNotNull(), F.col("hard")).when(dup, "duplicate").when(~F.col("in_domain"), "missing_context"))


def scored(judged: DataFrame) -> DataFrame:
    """Components, penalties, score, band, role, claim status; zero and 'noise' for records with a reason."""
    b = lambda c, n: F.when(c, n).otherwise(0)
    c = F.col
    comp = {
        "c_person": F.when(c("first_person"), 20).when(c("practitioner") & c("diagnostic"), 15).otherwise(0),
        "c_product": b(c("product_hit") | c("market"), 15),
        "c_context": b(c("context") | c("vehicle") | c("platform_hit") | c("vehicle_hit") | c("approved"), 15),
        "c_outcome": b(c("outcome"), 20),
        "c_purchase": b(c("purchase"), 10),
        "c_diagnostic": b(c("diagnostic"), 10),
        "c_engagement": F.least(F.lit(5), F.floor(F.log1p(F.greatest(F.coalesce("score", F.lit(0)), F.lit(0)).cast("double")))).cast("int"),
    }
    minus = {"m_short": b(c("short"), 5), "m_advert": b(c("advert"), 10), "m_quote": b(c("quoted") & ~c("first_person"), 5)}
    x = judged.withColumns({k: F.when(c("reason").isNull(), v).otherwise(0) for k, v in (comp | minus).items()})
    total = sum((c(k) for k in comp), F.lit(0)) - sum((c(k) for k in minus), F.lit(0))
    x = x.withColumn("quality", F.when(c("reason").isNull(), F.greatest(F.lit(0), F.least(F.lit(100), total))).otherwise(0).cast("int"))
    seen = c("product_hit") | c("platform_hit")
    role = (
        F.when(c("reason").isNotNull(), "noise")
        .when(c("first_person") & (c("outcome") | c("completed")) & seen, "direct_experience")
        .when(c("practitioner") & c("diagnostic") & seen, "qualified_practitioner")
        .when(c("demand") & (c("context") | c("vehicle") | seen), "contextual_demand")
        .when(seen | (c("approved") & (c("outcome") | c("demand") | c("market"))), "market_observation")
        .otherwise("weak")
    )
    x = x.withColumn("role", role).withColumn("band", F.when(c("quality") >= 70, "high").when(c("quality") >= 50, "medium").when(c("quality") >= 30, "weak").otherwise("noise"))
    status = F.when(c("role").isin("direct_experience", "qualified_practitioner"), "fact").when(c("role").isin("contextual_demand", "market_observation"), "inference").otherwise("unknown")
    x = x.withColumn("claim_status", status).withColumn("eligible", ~c("role").isin("weak", "noise") & (c("quality") >= 50))
    return x.withColumn("weight", F.when(c("eligible"), F.when(c("role") == "contextual_demand", 0.65).otherwise(1.0)).otherwise(0.0))


def distribution(scored_rows: DataFrame) -> DataFrame:
    """Records of each record type and role, roles without any included."""
    n = scored_rows.groupBy("record_type", "role").agg(F.count("*").alias("n"))
    kinds = n.select("record_type").distinct()
    return kinds.select("record_type", F.explode(F.array(*[F.lit(r) for r in ROLES])).alias("role")).join(n, ["record_type", "role"], "left").select("record_type", "role", F.coalesce("n", F.lit(0)).alias("n"))


def relevant(flagged: DataFrame) -> Column:
    """High-recall filter before a deep read: nothing excludes the record, duplicates aside, and it lies in the domain."""
    return F.col("hard").isNull() & F.col("in_domain")
