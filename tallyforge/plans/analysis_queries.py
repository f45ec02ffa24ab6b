"""Queries over analyses by rules, topic cards, references, libraries' lookups and projections for prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import text as T
from tallyforge.operators import analysis as A
from tallyforge.operators import claims as C
from tallyforge.operators import keywords as K
from tallyforge.operators import topics as P
from tallyforge.plans import evidence_queries as E
from tallyforge.plans import text_queries as X
from tallyforge.plans.listing_queries import HOST, _collapse
from tallyforge.sources.tables import table

FIELDS = ["platform", "vehicle", "scenario", "goal"]


def analyses(spark: SparkSession, folder: str) -> DataFrame:
    return A.extract(table(spark, folder, "posts"), X.LEXICON)


def q_rule_extract(spark, folder):
    j = lambda c: F.array_join(c, ",").alias(c)
    return analyses(spark, folder).select("post_id", *FIELDS, j("products"), j("brands"), j("pains"), j("solutions"), j("topics"), F.length("claim").alias("claim_chars"), "sentiment")


def q_analysis_join(spark, folder):
    """Threads with their analyses; threads without one (nothing known in them) are dropped."""
    a = analyses(spark, folder).filter("size(products) > 0 OR size(pains) > 0 OR platform <> 'unknown'")
    n = table(spark, folder, "comments").groupBy("post_id").agg(F.count_distinct("comment_id").alias("n_comments"))
    return table(spark, folder, "posts").select("post_id", "score").join(a, "post_id").join(n, "post_id", "left").select("post_id", "score", F.size("pains").cast("long").alias("n_pains"), "platform", F.coalesce("n_comments", F.lit(0)).alias("n_comments"))


def q_seed_topics(spark, folder):
    """Topics of each analysis; its first claim stands in where there are none."""
    return analyses(spark, folder).select("post_id", F.explode(A.seeded(F.col("topics"), F.col("claim"))).alias("topic"))


def q_analysis_payload(spark, folder):
    """What is known of each post, for a prompt."""
    return analyses(spark, folder).select("post_id", F.array_join(A.known_fields(FIELDS), "; ").alias("payload"))


def q_claim_fields(spark, folder):
    """Fields of candidates with the citations that are known, by the checked form; anything else is unknown."""
    rows = E._fields(spark, folder).groupBy("candidate_id").agg(F.first("term").alias("term"), F.first("status").alias("status"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"), F.collect_set(F.when(F.col("known"), F.col("id"))).alias("known"))
    x = rows.withColumn("f", C.checked(F.coalesce("term", F.lit("")), F.col("ids"), F.col("status"), F.col("known")))
    return x.select("candidate_id", F.col("f.value").alias("value"), F.array_join("f.evidence_ids", ",").alias("evidence_ids"), F.col("f.status").alias("status"))


def q_claim_citations(spark, folder):
    """Whether the first two comments of each thread, cited with their urls, stand (every seventh thread's urls are swapped)."""
    t = E.thread_comments(spark, folder)
    two = t.withColumn("n", F.row_number().over(Window.partitionBy("post_id").orderBy("ord", "comment_id"))).filter("n <= 2")
    g = two.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("n", "comment_id", "url"))).alias("c"))
    ids, urls = F.transform("c", lambda x: x["comment_id"]), F.transform("c", lambda x: x["url"])
    swapped = F.when(F.pmod(F.length("post_id") + F.ascii(F.substring("post_id", -1, 1)), F.lit(7)) == 0, F.reverse(urls)).otherwise(urls)
    return g.select("post_id", C.cited(ids, swapped, F.map_from_arrays(ids, urls)).alias("ok"))


# --- topics ------------------------------------------------------------------------------------------------------------
def _claim_counts(spark, folder):
    """Pains and gaps said in a topic's posts and their comments."""
    c = E.claims(spark, folder).groupBy("post_id").agg(F.count(F.when(F.col("field") == "pain", 1)).alias("pains"), F.count(F.when(F.col("field") == "solution_gap", 1)).alias("gaps"))
    return E.topic_posts(spark, folder).join(c, "post_id").groupBy("community", "key").agg(F.sum("pains").alias("n_pains"), F.sum("gaps").alias("n_gaps"))


def q_decision(spark, folder):
    """Product decision of each topic and what is still to be asked."""
    x = E.counts(spark, folder).select("community", "key", "topic_id").join(_claim_counts(spark, folder), ["community", "key"], "left").fillna(0, ["n_pains", "n_gaps"])
    key = F.element_at(F.array(*[F.lit(k) for k in ("improve_existing", "New_Product ", "unheard_of", "no_product")]), F.pmod(F.length("key"), F.lit(4)) + 1)
    return x.select("topic_id", A.decision(key, F.col("n_gaps")).alias("decision"), F.array_join(A.questions(F.col("n_pains"), F.col("n_gaps")), "|").alias("questions"))


def q_topic_rates(spark, folder):
    """Daily rates, growth and the trend's name."""
    x = E.counts(spark, folder).withColumn("now", F.round(F.col("n_current") / 30, 4)).withColumn("before", F.round(F.col("n_baseline") / 60, 4))
    return x.select("topic_id", F.round(F.coalesce(A.growth(F.col("now"), F.col("before")), F.lit(-9.0)) * 1000).cast("long").alias("growth1000"), A.trend_label(F.col("trend")).alias("trend_label"))


def q_analysis_counts(spark, folder):
    """All totals a report shows, worked out once."""
    t = E.counts(spark, folder).agg(F.count("*").alias("topic_count"), F.count(F.when(F.col("status") == "formal", 1)).alias("formal_topic_count"), F.count(F.when(F.col("status") == "weak_signal", 1)).alias("weak_topic_count"))
    e = E.q_sheet_evidence(spark, folder).agg(F.count("*").alias("evidence_count"))
    c = table(spark, folder, "communities").agg(F.count("*").alias("community_count"))
    k = table(spark, folder, "keyword_candidates").agg(F.count("*").alias("keyword_count"))
    out = t
    for one in (e, c, k):
        out = out.join(F.broadcast(one), F.lit(True))  # one row each
    return out


def q_sheet_cards(spark, folder):
    """The card of each formal topic."""
    x = E.heated(spark, folder).filter("status = 'formal'").join(_claim_counts(spark, folder), ["community", "key"], "left").fillna(0, ["n_pains", "n_gaps"])
    ev = E.q_sheet_evidence(spark, folder).groupBy("community", "key").agg(F.count("*").alias("n_evidence"), F.min("url").alias("first_url"))
    x = P.signal(x.join(ev, ["community", "key"], "left").fillna(0, ["n_evidence"]).withColumn("confidence", F.lit(0.5)), "confidence", "n_evidence")
    now, before = F.round(F.col("n_current") / 30, 4), F.round(F.col("n_baseline") / 60, 4)
    return x.select(
        "topic_id", "community", "key", "trend", A.trend_label(F.col("trend")).alias("trend_label"), "n_posts", "n_authors", "n_commenters", "n_participants", "n_comments", "upvotes", "n_current", "n_baseline", F.round(now * 10000).cast("long").alias("rate_now"), F.round(before * 10000).cast("long").alias("rate_before"),
        F.round(F.coalesce(A.growth(now, before), F.lit(-9.0)) * 1000).cast("long").alias("growth1000"), F.round(F.col("heat") * 100).cast("long").alias("heat100"), F.round(F.col("signal") * 10).cast("long").alias("signal10"), "priority", "n_pains", "n_gaps", "n_evidence", F.coalesce("first_url", F.lit("")).alias("first_url"), A.decision(F.lit("new_product"), F.col("n_gaps")).alias("decision"), F.array_join(A.questions(F.col("n_pains"), F.col("n_gaps")), "|").alias("questions"),
    )


def q_views(spark, folder):
    """What the comments of a topic's posts say for and against, by their score."""
    e = E.topic_posts(spark, folder).join(E.thread_comments(spark, folder), "post_id").select("community", "key", "ord", F.when(F.col("score") < 0, "opposing").when(F.col("score") > 50, "loud").otherwise("supporting").alias("stance"), T.clip(F.lower("body"), 40).alias("claim"))
    return A.views(e, ["community", "key"]).groupBy("community", "key", "stance").agg(F.count("*").alias("n_claims"), F.sum("n").alias("n_refs"))


def q_scene_cards(spark, folder):
    """Scenes of a topic: its posts' scenarios, else their vehicles, at most six."""
    m = E.topic_posts(spark, folder).join(analyses(spark, folder), "post_id")
    known = lambda c: F.when(F.col(c) != "unknown", F.col(c))
    g = m.groupBy("community", "key").agg(F.array_sort(F.collect_set(known("scenario"))).alias("scenes"), F.array_sort(F.collect_set(known("vehicle"))).alias("vehicles"))  # of fixed lexicons
    return g.select("community", "key", F.array_join(F.slice(F.when(F.size("scenes") > 0, F.col("scenes")).otherwise(F.col("vehicles")), 1, 6), ",").alias("scenes"))


def q_claim_refs(spark, folder):
    """Citations of candidates, of a post or of any, that their topic's evidence has."""
    ev = E.q_sheet_evidence(spark, folder).select(F.concat_ws("|", "community", "key").alias("topic"), "post_id", "evidence_id")
    refs = E._refs(spark, folder).join(E._proposals(spark, folder).select("prop_id", "community", "key").distinct(), "prop_id")
    refs = refs.select(F.concat_ws("|", "community", "key").alias("topic"), F.when(F.col("prop_id") % 5 == 0, "").otherwise(F.col("post_id")).alias("post_id"), "evidence_id").distinct()
    return A.cited_evidence(refs, ev).groupBy("topic").agg(F.count("*").alias("n"))


# --- lookups -----------------------------------------------------------------------------------------------------------
def q_display_names(spark, folder):
    """The first spelling of each community."""
    return E._posts(spark, folder).filter("community IS NOT NULL").groupBy("community").agg(F.min_by(F.trim("subreddit"), F.struct("created_at", "post_id")).alias("display"))


def q_keyword_urls(spark, folder):
    """Keywords with the urls of the posts they come from."""
    k = E._library_keywords(spark, folder, True).unionByName(E._library_keywords(spark, folder, False)).select("term", F.explode("ids").alias("post_id")).distinct()
    p = table(spark, folder, "posts").select("post_id", T.canonical_url(F.col("url"), HOST).alias("url"))
    return k.join(p, "post_id").filter(F.col("url").rlike("^https?://")).groupBy("term").agg(F.count_distinct("url").alias("n_urls"), F.min("url").alias("first_url"))


def q_keyword_approvals(spark, folder):
    """Library keywords that an approval (here the communities' own terms) names; by term alone, as keywords are global."""
    lib = E.q_library_keywords(spark, folder)
    ok = table(spark, folder, "communities").select(F.explode("include_terms").alias("t")).select(T.keyword_norm(F.col("t")).alias("term")).distinct()
    return lib.join(ok.withColumn("approved", F.lit(True)), "term", "left").select("term", F.when(F.col("approved"), "approved").otherwise(F.col("status")).alias("status"))


def q_library_migrated(spark, folder):
    """Earlier keyword rows keyed anew by their term, their communities folded into one list."""
    k = table(spark, folder, "keyword_candidates").select(T.blank_to_null(T.keyword_norm(F.col("normalized_term"))).alias("key"), F.explode_outer("communities").alias("c")).filter("key IS NOT NULL")
    return k.groupBy("key").agg(F.count_distinct(T.community_key(F.col("c"))).alias("n_communities"), F.min(T.community_key(F.col("c"))).alias("first_community"))


def q_legacy_keywords(spark, folder):
    """Candidates of old runs as library rows, numbered within their run, with defaults."""
    w = Window.partitionBy("run_id").orderBy("candidate_id")
    k = table(spark, folder, "keyword_candidates").withColumn("n", F.row_number().over(w))
    return k.select("candidate_id", F.concat(F.lit("kw_legacy_"), F.col("n").cast("string")).alias("keyword_id"), F.coalesce("term", F.lit("")).alias("term"), F.lit("candidate").alias("keyword_type"), F.coalesce(F.size("source_post_ids"), F.lit(0)).cast("long").alias("post_count"), F.coalesce("discovery_score", F.lit(0)).cast("long").alias("score"), F.coalesce("status", F.lit("candidate_review")).alias("status"))


def q_thread_files(spark, folder):
    """Batch posts with their threads; those without one are failures."""
    p = table(spark, folder, "post_batches").select(T.post_id(F.col("post_id")).alias("post_id")).filter("post_id IS NOT NULL").distinct()
    t = table(spark, folder, "comments").groupBy("post_id").agg(F.count_distinct("comment_id").alias("n"))
    return p.join(t, "post_id", "left").groupBy(F.when(F.col("n").isNull(), "missing_thread").otherwise("read").alias("state")).agg(F.count("*").alias("n_posts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_comments"))


def q_batch_results(spark, folder):
    """Rows asked for by bare id against what came, with or without the prefix."""
    bare = lambda c: F.regexp_replace(T.collapse(F.lower(c)), "^t3_", "")
    asked = table(spark, folder, "post_batches").select("row_id", bare(F.col("post_id")).alias("k")).filter("k <> ''")
    came = table(spark, folder, "posts").select(bare(F.col("post_id")).alias("k"), F.lit(True).alias("there"))
    return asked.join(came, "k", "left").groupBy(F.coalesce("there", F.lit(False)).alias("came")).agg(F.count("*").alias("n"), F.count_distinct("k").alias("n_ids"))


def q_coverage_lookup(spark, folder):
    """Catalogue communities with the metrics that go by their normalised name."""
    m = E._posts(spark, folder).groupBy("community").agg(F.count("*").alias("n_posts"))
    c = table(spark, folder, "communities").select("community_id", T.community_key(F.col("name")).alias("community"))
    return c.join(m, "community", "left").select("community_id", F.coalesce("n_posts", F.lit(0)).alias("n_posts"))


def q_all_communities(spark, folder):
    """Communities of an aggregate run: the catalogue's and those seen in threads."""
    a = table(spark, folder, "communities").select(T.community_key(F.col("name")).alias("community"))
    b = E._posts(spark, folder).select("post_id", "community").join(table(spark, folder, "comments").select("post_id").distinct(), "post_id", "left_semi").select("community")
    return a.unionByName(b).filter("community IS NOT NULL").distinct()


def q_select_communities(spark, folder):
    """The wanted communities of the catalogue in any case, and wanted ones that it lacks."""
    want = spark.createDataFrame([("RigWrench",), ("HAULERS",), ("nowhere",)], "want string").select(F.lower("want").alias("community"))
    have = table(spark, folder, "communities").select(T.community_key(F.col("name")).alias("community"), "community_id")
    return want.join(have, "community", "left").select("community", F.coalesce("community_id", F.lit("unknown")).alias("community_id"))


# --- projections -------------------------------------------------------------------------------------------------------
def q_prompt_comments(spark, folder):
    """The first eight comments of each thread, clipped for a prompt."""
    t = E.thread_comments(spark, folder).withColumn("n", F.row_number().over(Window.partitionBy("post_id").orderBy("ord", "comment_id"))).filter("n <= 8")
    return t.select("post_id", "n", "comment_id", T.clip(F.col("body"), 500).alias("body"))


def q_excerpts(spark, folder):
    """Source texts of evidence: the title or body of a post, a comment's body, clipped."""
    p = table(spark, folder, "posts").select(F.lit("post").alias("kind"), F.col("post_id").alias("id"), F.concat_ws(" — ", T.blank_to_null(F.trim("title")), T.blank_to_null(F.trim("body"))).alias("text"))
    c = E.thread_comments(spark, folder).select(F.lit("comment").alias("kind"), F.col("comment_id").alias("id"), F.col("body").alias("text"))
    x = p.unionByName(c).withColumn("excerpt", T.clip(F.col("text"), 420))
    return x.select("kind", "id", F.when(F.col("excerpt") != "", F.col("excerpt")).otherwise("未提供原文").alias("excerpt"))


def q_keyword_preview(spark, folder):
    """The first ten distinct keywords a dashboard shows."""
    k = table(spark, folder, "keyword_candidates").withColumn("t", T.keyword_norm(F.col("normalized_term"))).filter(K.searchable(F.col("t")))
    return k.groupBy(F.col("t").alias("term")).agg(F.min("candidate_id").alias("first_id")).orderBy("first_id").limit(10)


def q_planner_terms(spark, folder):
    """Terms a planner proposed: those that hold a platform or are keywords, once each."""
    k = table(spark, folder, "keyword_candidates").withColumn("t", T.keyword_norm(F.col("term"))).filter("t <> ''")
    ok = K.searchable(F.col("t")) | F.col("t").rlike(T.any_of(X.LEXICON.platforms))
    return k.filter(ok).groupBy(F.col("t").alias("term")).agg(F.min("candidate_id").alias("first_id"))


def q_pool_sorted(spark, folder):
    """Places of the pool's rows by date, engagement and id, the latest first."""
    from tallyforge.operators import overview as O

    w = Window.partitionBy("source").orderBy(F.col("published").desc(), F.col("engagement").desc(), F.col("evidence_id").desc())
    return O.pool(E._pool_rows(spark, folder)).withColumn("place", F.row_number().over(w)).filter("place <= 50").select("source", "place", "evidence_id")


def q_ring_layout(spark, folder):
    """Ring and place of each formal topic of a community, seven on a ring, by key."""
    t = E.counts(spark, folder).filter("status = 'formal'")
    n = F.row_number().over(Window.partitionBy("community").orderBy("key")) - 1
    return t.select("topic_id", n.alias("n")).select("topic_id", F.expr("n div 7").alias("ring"), (F.col("n") % 7).cast("long").alias("place"))


def q_trend_cards(spark, folder):
    """Nominations (candidates) that were judged on, with a cluster and evidence with a url."""
    k = table(spark, folder, "keyword_candidates").select(F.col("candidate_id").cast("string").alias("id"), F.col("term").alias("name"), F.coalesce("run_id", F.lit("")).alias("cluster_id"), F.explode(F.array_distinct(F.transform("source_post_ids", lambda x: T.post_id(x)))).alias("post_id"))
    p = table(spark, folder, "posts").select("post_id", T.canonical_url(F.col("url"), HOST).alias("url"))
    names = table(spark, folder, "keyword_candidates").filter("candidate_id % 3 <> 0").select(F.col("candidate_id").cast("string").alias("id"), F.when(F.col("candidate_id") % 2 == 0, F.col("normalized_term")).alias("name"))
    return A.surviving(k.join(p, "post_id"), names)


def q_angles(spark, folder):
    """Angle rows (comments) bound to posts that survived."""
    alive = table(spark, folder, "posts").filter("score >= 10").select("post_id")
    return table(spark, folder, "comments").join(alive, "post_id", "left_semi").groupBy("post_id").agg(F.count_distinct("comment_id").alias("n_angles"))


QUERIES = {
    f.__name__: f
    for f in (q_rule_extract, q_analysis_join, q_seed_topics, q_analysis_payload, q_claim_fields, q_claim_citations, q_decision, q_topic_rates, q_analysis_counts, q_sheet_cards, q_views, q_scene_cards, q_claim_refs, q_display_names, q_keyword_urls, q_keyword_approvals, q_library_migrated, q_legacy_keywords, q_thread_files, q_batch_results, q_coverage_lookup, q_all_communities, q_select_communities, q_prompt_comments, q_excerpts, q_keyword_preview, q_planner_terms, q_pool_sorted, q_ring_layout, q_trend_cards, q_angles)
}

_C = E._KEY
_U = E._url
_NORM = "array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' ')"
_HASW = lambda ts: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)') THEN '{w}' END" for w in ts) + "], lambda z: z IS NOT NULL)"
_NOTIN = "regexp_replace(t, 'broken\\s+in', ' ', 'g')"  # the SQL engine has no lookahead
_EXTRACT = f"""
an0 AS (SELECT post_id, title, body, score, lower(concat_ws(' ', coalesce(title, ''), coalesce(body, ''))) AS t FROM posts),
an1 AS (SELECT *, {_HASW(('korvan', 'varga nord', 'mistrune', 'ostrelle'))} AS platforms, ({_HASW(('turbo actuator', 'oil pan', 'boost hose', 'fuel filter housing', 'exhaust brake', 'lift pump', 'soot filter', 'head gasket'))})[1:8] AS products, {_HASW(('packhorse', 'carrier 9', 'atlas 7', 'range pro'))} AS vehicles, {_HASW(('towing uphill', 'freezing rain'))} AS scenarios, {_HASW(('korvan', 'mistrune'))} AS brands,
  ({_HASW(('oem', 'aftermarket', 'replace', 'replacement', 'tune', 'tuner', 'clamp', 'kit'))})[1:5] AS solutions, {_HASW(('buy', 'recommend', 'need', 'looking for', 'what should'))} AS goals,
  (list_filter([CASE WHEN regexp_matches(t, 'leak|seep') THEN 'leak/seep' END, CASE WHEN regexp_matches({_NOTIN}, 'fail|failed|failure|broken|crack') THEN 'failure' END, CASE WHEN regexp_matches(t, 'fitment|fit|compatib') THEN 'fitment' END, CASE WHEN regexp_matches(t, 'install|installation|clearance') THEN 'installation complexity' END, CASE WHEN regexp_matches(t, 'regen|regeneration|dpf') THEN 'regeneration/DPF' END, CASE WHEN regexp_matches(t, 'clog|clogged') THEN 'clogging' END], lambda z: z IS NOT NULL))[1:5] AS pains FROM an0),
an2 AS (SELECT *, flatten(list_transform(products[1:2], lambda p: list_transform(CASE WHEN len(pains) > 0 THEN pains[1:2] ELSE ['fitment'] END, lambda q: p || ' ' || q))) AS pairs FROM an1),
an AS (SELECT *, coalesce(platforms[1], 'unknown') AS platform, coalesce(vehicles[1], 'unknown') AS vehicle, coalesce(scenarios[1], 'unknown') AS scenario, coalesce(goals[1], 'unknown') AS goal,
  (CASE WHEN len(pairs) > 0 THEN pairs WHEN len(pains) > 0 AND len(platforms) > 0 THEN [platforms[1] || ' ' || pains[1]] ELSE [] END)[1:3] AS topics, substr(coalesce(nullif(trim(title), ''), trim(coalesce(body, ''))), 1, 500) AS claim FROM an2)"""
_SAYS = ", cc AS (SELECT post_id, count(*) FILTER (field = 'pain') AS pains, count(*) FILTER (field = 'solution_gap') AS gaps FROM claims GROUP BY 1), says AS (SELECT community, key, sum(pains)::BIGINT AS n_pains, sum(gaps)::BIGINT AS n_gaps FROM tp JOIN cc USING (post_id) GROUP BY 1, 2)"
_ASK = "concat_ws('|', CASE WHEN coalesce(n_pains, 0) = 0 THEN '是否有更多独立作者描述同一具体问题？' END, CASE WHEN coalesce(n_gaps, 0) = 0 THEN '现有产品或维修办法具体缺少哪一项能力？' END, CASE WHEN n_pains > 0 AND n_gaps > 0 THEN '同一车型、负载或安装条件下，问题是否会重复发生？' END)"
_GROW = "round(coalesce(CASE WHEN round(n_baseline / 60.0::DOUBLE, 4) > 0 THEN round((round(n_current / 30.0::DOUBLE, 4) - round(n_baseline / 60.0::DOUBLE, 4)) / round(n_baseline / 60.0::DOUBLE, 4), 4) END, -9.0::DOUBLE) * 1000)::BIGINT AS growth1000"
_NAMES = "CASE trend WHEN 'new' THEN '新出现' WHEN 'rising' THEN '上升' WHEN 'stable' THEN '稳定' WHEN 'falling' THEN '下降' ELSE '未知' END AS trend_label"
_BARE = lambda x: f"regexp_replace({_collapse(f'lower({x})')}, '^t3_', '')"
ORACLE = {
    "q_rule_extract": "WITH " + _EXTRACT + " SELECT post_id, platform, vehicle, scenario, goal, array_to_string(products, ',') AS products, array_to_string(brands, ',') AS brands, array_to_string(pains, ',') AS pains, array_to_string(solutions, ',') AS solutions, array_to_string(topics, ',') AS topics, length(claim) AS claim_chars, CASE WHEN len(pains) > 0 THEN 'negative' ELSE 'neutral' END AS sentiment FROM an",
    "q_analysis_join": "WITH " + _EXTRACT + ", n AS (SELECT post_id, count(DISTINCT comment_id) AS n FROM comments GROUP BY 1) SELECT post_id, score, len(pains) AS n_pains, platform, coalesce(n, 0) AS n_comments FROM an LEFT JOIN n USING (post_id) WHERE len(products) > 0 OR len(pains) > 0 OR platform <> 'unknown'",
    "q_seed_topics": "WITH " + _EXTRACT + " SELECT post_id, unnest(CASE WHEN len(topics) > 0 THEN topics WHEN trim(claim) <> '' THEN [substr(claim, 1, 120)] ELSE [] END) AS topic FROM an",
    "q_analysis_payload": "WITH " + _EXTRACT + " SELECT post_id, concat_ws('; ', " + ", ".join(f"CASE WHEN {c} <> 'unknown' THEN '{c}=' || {c} END" for c in FIELDS) + ") AS payload FROM an",
    "q_claim_fields": "WITH " + E._FLD + ", g AS (SELECT candidate_id, any_value(term) AS term, any_value(status) AS status, list(id) AS ids, count(*) AS n, count(p.post_id) AS k FROM f LEFT JOIN posts p ON p.post_id = f.id GROUP BY 1), o AS (SELECT *, status IN ('fact', 'inference') AND n = k AND trim(coalesce(term, '')) <> '' AS ok FROM g), l AS (SELECT candidate_id, list_transform(source_post_ids, lambda x: " + E._ID("x") + ") AS ids FROM keyword_candidates) SELECT candidate_id, CASE WHEN ok THEN term ELSE 'unknown' END AS value, CASE WHEN ok THEN array_to_string(l.ids, ',') ELSE '' END AS evidence_ids, CASE WHEN ok THEN status ELSE 'unknown' END AS status FROM o JOIN l USING (candidate_id)",
    "q_claim_citations": "WITH " + E._THREAD + ", r AS (SELECT post_id, comment_id, url, row_number() OVER (PARTITION BY post_id ORDER BY ord, comment_id) AS n FROM thread QUALIFY n <= 2), g AS (SELECT post_id, count(*) AS k, max(url) FILTER (n = 1) AS u1, max(url) FILTER (n = 2) AS u2 FROM r GROUP BY 1) SELECT post_id, NOT ((length(post_id) + ascii(right(post_id, 1))) % 7 = 0 AND k = 2 AND u1 <> u2) AS ok FROM g",
    "q_decision": "WITH " + E._CLAIMS + "," + E._COUNTS + _SAYS + f" SELECT topic_id, CASE length(key) % 4 WHEN 0 THEN CASE WHEN coalesce(n_gaps, 0) > 0 THEN 'improve_existing' ELSE 'no_product' END WHEN 1 THEN CASE WHEN coalesce(n_gaps, 0) > 0 THEN 'new_product' ELSE 'no_product' END ELSE 'no_product' END AS decision, {_ASK} AS questions FROM topics LEFT JOIN says USING (community, key)",
    "q_topic_rates": "WITH " + E._COUNTS + f" SELECT topic_id, {_GROW}, {_NAMES} FROM topics",
    "q_analysis_counts": "WITH " + E._THREAD + "," + E._COUNTS + "," + E._KNOWN + " SELECT (SELECT count(*) FROM topics) AS topic_count, (SELECT count(*) FROM topics WHERE status = 'formal') AS formal_topic_count, (SELECT count(*) FROM topics WHERE status = 'weak_signal') AS weak_topic_count, (SELECT count(*) FROM tp JOIN known USING (post_id)) AS evidence_count, (SELECT count(*) FROM communities) AS community_count, (SELECT count(*) FROM keyword_candidates) AS keyword_count",
    "q_sheet_cards": "WITH " + E._CLAIMS + "," + E._HEAT + "," + E._KNOWN + _SAYS + f""", ev AS (SELECT community, key, count(*) AS n_evidence, min(url) AS first_url FROM tp JOIN known USING (post_id) GROUP BY 1, 2),
c AS (SELECT *, least(greatest(round(heat / 100 * 4 + 0.5::DOUBLE * 3 + least(1.0, coalesce(n_evidence, 0) / 12.0) * 2 + 1.0::DOUBLE, 1), 0), 10) AS signal FROM heat LEFT JOIN says USING (community, key) LEFT JOIN ev USING (community, key) WHERE status = 'formal')
SELECT topic_id, community, key, trend, {_NAMES}, n_posts, n_authors, n_commenters, n_participants, n_comments, upvotes, n_current, n_baseline, round(round(n_current / 30.0::DOUBLE, 4) * 10000)::BIGINT AS rate_now, round(round(n_baseline / 60.0::DOUBLE, 4) * 10000)::BIGINT AS rate_before, {_GROW}, round(heat * 100)::BIGINT AS heat100, round(signal * 10)::BIGINT AS signal10, CASE WHEN signal >= 7 THEN 'priority_validate' ELSE 'validate' END AS priority, coalesce(n_pains, 0) AS n_pains, coalesce(n_gaps, 0) AS n_gaps, coalesce(n_evidence, 0) AS n_evidence, coalesce(first_url, '') AS first_url, CASE WHEN n_gaps > 0 THEN 'new_product' ELSE 'no_product' END AS decision, {_ASK} AS questions FROM c""",
    "q_views": "WITH " + E._THREAD + "," + E._PROP + ", v AS (SELECT community, key, CASE WHEN score < 0 THEN 'opposing' ELSE 'supporting' END AS stance, substr(lower(body), 1, 40) AS claim, count(*) AS n FROM tp JOIN thread USING (post_id) GROUP BY 1, 2, 3, 4) SELECT community, key, stance, count(*) AS n_claims, sum(n)::BIGINT AS n_refs FROM v GROUP BY 1, 2, 3",
    "q_scene_cards": "WITH " + E._PROP + "," + _EXTRACT + ", g AS (SELECT community, key, list_sort(list(DISTINCT scenario) FILTER (scenario <> 'unknown')) AS s, list_sort(list(DISTINCT vehicle) FILTER (vehicle <> 'unknown')) AS v FROM tp JOIN an USING (post_id) GROUP BY 1, 2) SELECT community, key, coalesce(array_to_string((CASE WHEN len(s) > 0 THEN s ELSE v END)[1:6], ','), '') AS scenes FROM g",
    "q_claim_refs": "WITH " + E._THREAD + "," + E._PROP + "," + E._KNOWN + ", e AS (SELECT DISTINCT community || '|' || key AS topic, post_id, evidence_id FROM tp JOIN known USING (post_id)), r AS (SELECT DISTINCT community || '|' || key AS topic, CASE WHEN prop_id % 5 = 0 THEN '' ELSE post_id END AS post_id, CASE WHEN prop_id % 11 = 0 THEN evidence_id || 'x' ELSE evidence_id END AS evidence_id FROM prop JOIN known USING (post_id)), x AS (SELECT DISTINCT r.topic, e.post_id, r.evidence_id FROM r JOIN e ON e.topic = r.topic AND e.evidence_id = r.evidence_id AND (r.post_id = '' OR r.post_id = e.post_id)) SELECT topic, count(*) AS n FROM x GROUP BY 1",
    "q_display_names": f"SELECT {_C('subreddit')} AS community, arg_min(trim(subreddit), struct_pack(a := created_at, b := post_id)) AS display FROM posts WHERE {_C('subreddit')} IS NOT NULL GROUP BY 1",
    "q_keyword_urls": f"WITH k AS (SELECT DISTINCT term, id FROM (SELECT {E._TERM} AS term, unnest(list_transform(source_post_ids, lambda x: {E._ID('x')})) AS id FROM keyword_candidates WHERE found_at IS NOT NULL) WHERE term IS NOT NULL) SELECT term, count(DISTINCT {_U('url')}) AS n_urls, min({_U('url')}) AS first_url FROM k JOIN posts p ON p.post_id = k.id WHERE {_U('url')} IS NOT NULL GROUP BY 1",
    "q_keyword_approvals": E.ORACLE["q_library_keywords"].replace("SELECT term, CASE WHEN now IS NOT NULL", ", fin AS (SELECT term, CASE WHEN now IS NOT NULL", 1) + f"), ok AS (SELECT DISTINCT {_NORM.format('t')} AS term FROM (SELECT unnest(include_terms) AS t FROM communities)) SELECT fin.term, CASE WHEN ok.term IS NOT NULL THEN 'approved' ELSE fin.status END AS status FROM fin LEFT JOIN ok ON ok.term = fin.term",
    "q_library_migrated": f"WITH k AS (SELECT {E._TERM} AS key, unnest(CASE WHEN len(communities) > 0 THEN communities ELSE [NULL] END) AS c FROM keyword_candidates) SELECT key, count(DISTINCT {_C('c')}) AS n_communities, min({_C('c')}) AS first_community FROM k WHERE key IS NOT NULL GROUP BY 1",
    "q_legacy_keywords": "SELECT candidate_id, 'kw_legacy_' || row_number() OVER (PARTITION BY run_id ORDER BY candidate_id)::VARCHAR AS keyword_id, coalesce(term, '') AS term, 'candidate' AS keyword_type, coalesce(len(source_post_ids), 0) AS post_count, coalesce(discovery_score, 0)::BIGINT AS score, coalesce(status, 'candidate_review') AS status FROM keyword_candidates",
    "q_thread_files": f"WITH p AS (SELECT DISTINCT {E._ID('post_id')} AS post_id FROM post_batches), t AS (SELECT post_id, count(DISTINCT comment_id) AS n FROM comments GROUP BY 1) SELECT CASE WHEN n IS NULL THEN 'missing_thread' ELSE 'read' END AS state, count(*) AS n_posts, coalesce(sum(n), 0)::BIGINT AS n_comments FROM p LEFT JOIN t USING (post_id) WHERE p.post_id IS NOT NULL GROUP BY 1",
    "q_batch_results": f"WITH a AS (SELECT {_BARE('post_id')} AS k FROM post_batches), c AS (SELECT {_BARE('post_id')} AS k FROM posts) SELECT c.k IS NOT NULL AS came, count(*) AS n, count(DISTINCT a.k) AS n_ids FROM a LEFT JOIN c ON c.k = a.k WHERE a.k <> '' GROUP BY 1",
    "q_coverage_lookup": f"WITH m AS (SELECT {_C('subreddit')} AS community, count(*) AS n FROM posts GROUP BY 1) SELECT community_id, coalesce(n, 0) AS n_posts FROM communities c LEFT JOIN m ON m.community = {_C('c.name')}",
    "q_all_communities": f"SELECT {_C('name')} AS community FROM communities WHERE {_C('name')} IS NOT NULL UNION SELECT {_C('subreddit')} FROM posts WHERE post_id IN (SELECT post_id FROM comments) AND {_C('subreddit')} IS NOT NULL",
    "q_select_communities": f"SELECT w.community, coalesce(community_id, 'unknown') AS community_id FROM (SELECT unnest(['rigwrench', 'haulers', 'nowhere']) AS community) w LEFT JOIN communities c ON {_C('c.name')} = w.community",
    "q_prompt_comments": "WITH " + E._THREAD + " SELECT post_id, row_number() OVER (PARTITION BY post_id ORDER BY ord, comment_id) AS n, comment_id, substr(body, 1, 500) AS body FROM thread QUALIFY n <= 8",
    "q_excerpts": "WITH " + E._THREAD + f", x AS (SELECT 'post' AS kind, post_id AS id, concat_ws(' — ', nullif(trim(title), ''), nullif(trim(body), '')) AS t FROM posts UNION ALL SELECT 'comment', comment_id, body FROM thread) SELECT kind, id, CASE WHEN substr({_collapse('t')}, 1, 420) <> '' THEN substr({_collapse('t')}, 1, 420) ELSE '未提供原文' END AS excerpt FROM x",
    "q_keyword_preview": f"SELECT term, min(candidate_id) AS first_id FROM (SELECT {_NORM.format('coalesce(normalized_term, ' + chr(39) * 2 + ')')} AS term, candidate_id FROM keyword_candidates) WHERE {X._search('term')} GROUP BY 1 ORDER BY 2 LIMIT 10",
    "q_planner_terms": f"SELECT term, min(candidate_id) AS first_id FROM (SELECT {_NORM.format('coalesce(term, ' + chr(39) * 2 + ')')} AS term, candidate_id FROM keyword_candidates) WHERE term <> '' AND ({X._search('term')} OR regexp_matches(term, '\\b(?:korvan|varga nord|mistrune|ostrelle)\\b')) GROUP BY 1",
    "q_pool_sorted": "WITH " + E._POOL + " SELECT source, row_number() OVER (PARTITION BY source ORDER BY published DESC, engagement DESC, evidence_id DESC) AS place, evidence_id FROM pool QUALIFY place <= 50",
    "q_ring_layout": "WITH " + E._COUNTS + ", n AS (SELECT topic_id, row_number() OVER (PARTITION BY community ORDER BY key) - 1 AS n FROM topics WHERE status = 'formal') SELECT topic_id, n // 7 AS ring, n % 7 AS place FROM n",
    "q_trend_cards": f"WITH k AS (SELECT candidate_id::VARCHAR AS id, term AS name, coalesce(run_id, '') AS cluster_id, unnest(list_distinct(list_transform(source_post_ids, lambda x: {E._ID('x')}))) AS post_id FROM keyword_candidates), n AS (SELECT id, min(cluster_id) AS cluster_id, min(name) AS own, count(*) AS n_evidence FROM k JOIN posts USING (post_id) WHERE {_U('url')} IS NOT NULL AND cluster_id <> '' GROUP BY 1), w AS (SELECT candidate_id::VARCHAR AS id, CASE WHEN candidate_id % 2 = 0 THEN normalized_term END AS name FROM keyword_candidates WHERE candidate_id % 3 <> 0) SELECT id, coalesce(nullif(trim(w.name), ''), own, '') AS name, cluster_id, n_evidence FROM n JOIN w USING (id)",
    "q_angles": "SELECT post_id, count(DISTINCT comment_id) AS n_angles FROM comments WHERE post_id IN (SELECT post_id FROM posts WHERE score >= 10) GROUP BY 1",
}
