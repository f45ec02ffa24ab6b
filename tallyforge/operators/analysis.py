"""Analyses of posts by rules, their fields and references, and what topics are told from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions.vocabulary import Lexicon

#: What a post's pains, solutions and goals are told by.
PAINS = [(r"leak|seep", "leak/seep"), (r"fail|failed|failure|broken(?!\s+in)|crack", "failure"), (r"fitment|fit|compatib", "fitment"), (r"install|installation|clearance", "installation complexity"), (r"regen|regeneration|dpf", "regeneration/DPF"), (r"clog|clogged", "clogging")]
SOLUTIONS = ("oem", "aftermarket", "replace", "replacement", "tune", "tuner", "clamp", "kit")
GOALS = ("buy", "recommend", "need", "looking for", "what should")
#: Product decisions, and names of trends.
DECISIONS = ("improve_existing", "new_fitment_sku", "accessory_bundle", "new_product", "content_service", "no_product")
TRENDS = {"new": "新出现", "rising": "上升", "stable": "稳定", "falling": "下降"}
QUESTIONS = {"pain": "是否有更多独立作者描述同一具体问题？", "gap": "现有产品或维修办法具体缺少哪一项能力？", "both": "同一车型、负载或安装条件下，问题是否会重复发生？"}
#: Keys under which a claim's text comes, and the labels of its parts where it has none.
TEXT_KEYS = ("text", "value", "summary", "claim")
PART_LABELS = (("scene", "场景"), ("context", "条件"), ("goal", "目标"), ("task", "任务"), ("challenge", "挑战"), ("problem", "问题"))


def words_in(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms of a list that a lower-case text holds with no letter or figure beside them, in the list's order."""
    quoted = lambda t: "".join(c if c.isalnum() or c == " " else "\\" + c for c in t.lower())
    return F.array_compact(F.array(*[F.when(text.rlike(rf"(?<![a-z0-9]){quoted(t)}(?![a-z0-9])"), F.lit(t)) for t in terms])) if terms else F.array().cast("array<string>")


def extract(posts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """post_id and what rules find in title and body: platform, vehicle, scenario, goal ('unknown' without), lists of products, brands, pains, solutions and topics, claim, sentiment.

    A topic is one of the first two products with one of the first two pains ('fitment' without any), else the first
    platform with the first pain; at most three.
    """
    x = posts.withColumn("__t", F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))))
    t = F.col("__t")
    x = x.withColumns({"__platforms": words_in(t, lexicon.platforms), "products": F.slice(words_in(t, lexicon.products), 1, 8), "__vehicles": words_in(t, lexicon.vehicle_terms), "__scenarios": words_in(t, lexicon.scenarios), "brands": F.slice(words_in(t, lexicon.brands), 1, 8), "solutions": F.slice(words_in(t, SOLUTIONS), 1, 5), "__goals": words_in(t, GOALS)})
    x = x.withColumn("pains", F.slice(F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(n)) for p, n in PAINS])), 1, 5))
    two = F.when(F.size("pains") > 0, F.slice("pains", 1, 2)).otherwise(F.array(F.lit("fitment")))
    pairs = F.flatten(F.transform(F.slice("products", 1, 2), lambda p: F.transform(two, lambda q: F.concat_ws(" ", p, q))))
    alone = F.when((F.size("pains") > 0) & (F.size("__platforms") > 0), F.array(F.concat_ws(" ", F.get("__platforms", F.lit(0)), F.get("pains", F.lit(0))))).otherwise(F.array().cast("array<string>"))
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit("unknown"))
    claim = F.substring(F.coalesce(T.blank_to_null(F.trim("title")), F.trim(F.coalesce("body", F.lit("")))), 1, 500)
    return x.select("post_id", first("__platforms").alias("platform"), first("__vehicles").alias("vehicle"), first("__scenarios").alias("scenario"), first("__goals").alias("goal"), "products", "brands", "pains", "solutions", F.slice(F.array_distinct(F.when(F.size(pairs) > 0, pairs).otherwise(alone)), 1, 3).alias("topics"), claim.alias("claim"), F.when(F.size("pains") > 0, "negative").otherwise("neutral").alias("sentiment"))


def seeded(topics: Column, claim: Column) -> Column:
    """Topics of an analysis; without any, its first claim (120 characters) where there is one."""
    return F.when(F.size(topics) > 0, topics).when(F.trim(F.coalesce(claim, F.lit(""))) != "", F.array(F.substring(claim, 1, 120))).otherwise(F.array().cast("array<string>"))


def known_fields(fields: list[str]) -> Column:
    """name=value of the fields that are known, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("unknown")) != "unknown", F.concat(F.lit(f"{c}="), F.col(c))) for c in fields]))


def decision(key: Column, hypotheses: Column) -> Column:
    """The product decision that stands: 'no_product' for unknown keys and where no opportunity was claimed."""
    k = F.lower(F.trim(F.coalesce(key, F.lit(""))))
    return F.when(k.isin(*DECISIONS) & ((k == "no_product") | (hypotheses > 0)), k).otherwise("no_product")


def trend_label(trend: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TRENDS.items() for x in kv])[trend], F.lit("未知"))


def growth(current: Column, baseline: Column) -> Column:
    """Change of the daily rate (four decimals); null without a baseline."""
    return F.when(baseline > 0, F.round((current - baseline) / baseline, 4))


def questions(n_pains: Column, n_gaps: Column) -> Column:
    """What is still to be asked about a topic."""
    return F.array_compact(F.array(F.when(n_pains == 0, F.lit(QUESTIONS["pain"])), F.when(n_gaps == 0, F.lit(QUESTIONS["gap"])), F.when((n_pains > 0) & (n_gaps > 0), F.lit(QUESTIONS["both"]))))


def views(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stance, claim, n, first: what is said for and against; ``evidence``: keys, ord, stance, claim; other stances count as supporting."""
    stance = F.when(F.col("stance") == "opposing", "opposing").otherwise("supporting")
    return evidence.groupBy(*keys, stance.alias("stance"), "claim").agg(F.min("ord").alias("first"), F.count("*").alias("n"))


def claim_text(raw: Column) -> Column:
    """The text of a claim that may be a string or an object: its text, value, summary or claim, else its labelled parts."""
    get = lambda k: T.blank_to_null(F.trim(F.try_variant_get(raw, f"$.{k}", "string")))
    parts = F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{label}："), get(k)) for k, label in PART_LABELS])), "；")
    whole = F.when(~F.schema_of_variant(raw).startswith("OBJECT"), F.trim(F.try_variant_get(raw, "$", "string")))
    return F.coalesce(whole, *[get(k) for k in TEXT_KEYS], T.blank_to_null(parts), F.lit(""))


def references(raw: Column) -> Column:
    """array<struct<post_id, evidence_id>> from a list of objects, of 'post:evidence' texts or of bare ids (post_id then blank), or from the keys of an object."""
    inner = F.coalesce(F.try_variant_get(raw, "$.evidence", "variant"), raw)
    rows = F.coalesce(F.try_variant_get(inner, "$", "array<variant>"), F.transform(F.map_keys(F.try_variant_get(inner, "$", "map<string,variant>")), lambda k: F.parse_json(F.to_json(F.array(k)))), F.array().cast("array<variant>"))

    def one(v: Column) -> Column:
        get = lambda k: T.blank_to_null(F.trim(F.try_variant_get(v, f"$.{k}", "string")))
        said = F.trim(F.coalesce(F.try_variant_get(v, "$[0]", "string"), F.try_variant_get(v, "$", "string")))
        obj = F.schema_of_variant(v).startswith("OBJECT")
        at = F.instr(said, ":")
        post = F.when(obj, get("post_id")).when(at > 0, F.substring_index(said, ":", 1)).otherwise("")
        evidence = F.when(obj, F.coalesce(get("evidence_id"), get("id"))).when(at > 0, F.substring(said, at + 1, F.length(said))).otherwise(T.blank_to_null(said))
        return F.struct(post.alias("post_id"), evidence.alias("evidence_id"))

    return F.filter(F.transform(rows, one), lambda r: r["post_id"].isNotNull() & r["evidence_id"].isNotNull())


def cited_evidence(refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """The references whose evidence (and post, where they name one) the topic has.  ``refs``: topic, post_id ('' for any), evidence_id; ``evidence``: topic, post_id, evidence_id."""
    e = evidence.select("topic", F.col("post_id").alias("e_post"), "evidence_id").distinct()
    return refs.join(e, ["topic", "evidence_id"]).filter((F.col("post_id") == "") | (F.col("post_id") == F.col("e_post"))).select("topic", F.col("e_post").alias("post_id"), "evidence_id").distinct()


def surviving(nominations: DataFrame, names: DataFrame) -> DataFrame:
    """Trend cards of nominations that were judged on (``names``: id, name), have a cluster and evidence with a url.  ``nominations``: id, name, cluster_id, url."""
    n = nominations.filter((F.coalesce("url", F.lit("")) != "") & (F.coalesce("id", F.lit("")) != "") & (F.coalesce("cluster_id", F.lit("")) != ""))
    g = n.groupBy("id").agg(F.min("cluster_id").alias("cluster_id"), F.min("name").alias("own"), F.count("*").alias("n_evidence"))
    return g.join(names.select("id", F.col("name").alias("given")), "id").select("id", F.coalesce(T.blank_to_null(F.trim("given")), F.col("own"), F.lit("")).alias("name"), "cluster_id", "n_evidence")
