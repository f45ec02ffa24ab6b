"""Queries over threads, claims, topics, libraries, evidence pools, graphs and report sheets."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import claims as C
from tallyforge.operators import keywords as K
from tallyforge.operators import library as L
from tallyforge.operators import overview as O
from tallyforge.operators import threads as H
from tallyforge.operators import topics as P
from tallyforge.plans.listing_queries import _collapse, _url
from tallyforge.plans.text_queries import _search
from tallyforge.session import written
from tallyforge.sources.tables import table

AS_OF = datetime(2026, 6, 15)
CHUNK = 2_000
REPLIES, LEVELS = 4, 6
SEEDS = ["rigwrench", "haulers"]
ANCHORS, EXCLUDED = ["diesel", "truck", "turbo", "injector", "pump"], ["penalty", "recipe"]
LENSES = [("failure", r"(?i)\b(?:fail|broke|crack|leak|seiz|snapp)"), ("fit", r"(?i)\b(?:fit|fits|clearance|aftermarket)\b"), ("cost", r"(?i)\b(?:cost|price|money|bank|tax)\b"), ("advice", r"(?i)\b(?:advice|ask|question|numbers)\b"), ("law", r"(?i)\b(?:court|judge|clause|statute)\b"), ("other", r"(?i)\bother\b")]


# --- threads -----------------------------------------------------------------------------------------------------------
def thread_comments(spark: SparkSession, folder: str) -> DataFrame:
    posts = table(spark, folder, "posts").select("post_id", T.canonical_url(F.col("url"), "https://forum.example").alias("post_url"))
    return H.parse(H.deliveries(table(spark, folder, "comments")).join(posts, "post_id", "left"))


def q_thread_parse(spark, folder):
    return thread_comments(spark, folder).select("post_id", "ord", "comment_id", "url", F.coalesce("parent", F.lit("")).alias("parent"), F.col("depth").cast("long").alias("depth"), "score", F.length("body").alias("chars"))


def q_thread_flatten(spark, folder):
    return H.flatten(thread_comments(spark, folder), REPLIES, LEVELS).select("post_id", "comment_id", F.col("level").cast("long").alias("level"), "path")


def q_comment_chunks(spark, folder):
    return H.chunks(thread_comments(spark, folder), CHUNK)


def q_fixed_chunks(spark, folder):
    return H.fixed_chunks(table(spark, folder, "keyword_candidates"), "run_id", "candidate_id", 8).groupBy("run_id", "chunk").agg(F.count("*").alias("n"), F.min("candidate_id").alias("first_id"))


def commenters(spark, folder):
    return H.commenters(table(spark, folder, "comments"), table(spark, folder, "posts"))


def q_commenters(spark, folder):
    return commenters(spark, folder).groupBy("post_id").agg(F.count("*").alias("n_commenters"))


# --- claims ------------------------------------------------------------------------------------------------------------
def claims(spark, folder):
    x = thread_comments(spark, folder).select("post_id", F.col("comment_id").alias("evidence_id"), "author", F.col("body").alias("text"))
    p = table(spark, folder, "posts").select("post_id", F.col("post_id").alias("evidence_id"), F.coalesce("author", F.lit("")).alias("author"), F.col("body").alias("text"))
    return C.distinct(C.from_sentences(p.unionByName(x)))


def q_sentences(spark, folder):
    return table(spark, folder, "posts").select("post_id", F.posexplode(T.sentences(F.col("body"))).alias("pos", "sentence")).groupBy("sentence").agg(F.count("*").alias("n"))


def q_voc_claims(spark, folder):
    return claims(spark, folder).groupBy("field", "status", "severity").agg(F.count("*").alias("n"), F.count_distinct("post_id").alias("n_posts"))


def topic_claims(spark, folder):
    """Claims of each topic (lens) of a post, of those sentences that are about it."""
    lens = F.explode(O.labels(F.concat_ws(" ", "title", "body"), LENSES)).alias("topic")
    of_post = table(spark, folder, "posts").select("post_id", lens)
    about = F.array_compact(F.array(*[F.when(F.col("source_text").rlike(p), F.lit(n)) for n, p in LENSES]))
    return claims(spark, folder).withColumn("about", about).join(of_post, "post_id").filter(F.array_contains("about", F.col("topic"))).drop("about")


def q_voc_aggregate(spark, folder):
    return C.aggregate(topic_claims(spark, folder), ["topic"])


def q_voc_opportunity(spark, folder):
    """The strongest repeated gap of each topic in which a pain repeats too."""
    return C.opportunities(written(q_voc_aggregate(spark, folder), "claims"), ["topic"])


def q_voc_evidence(spark, folder):
    """Distinct evidence with a url behind the claims, for each field."""
    c = claims(spark, folder)
    known = _known(spark, folder).unionByName(table(spark, folder, "posts").select("post_id", F.col("post_id").alias("evidence_id"), T.canonical_url(F.col("url"), "https://forum.example").alias("url")))
    return C.evidence(c, known).groupBy("post_id").agg(F.count("*").alias("n_evidence"), F.min("url").alias("first_url"))


def _fields(spark, folder):
    """Candidates as analysis fields: value, citations, status."""
    k = table(spark, folder, "keyword_candidates")
    known = table(spark, folder, "posts").select(F.col("post_id").alias("id"))
    each = k.select("candidate_id", "term", F.when(F.col("candidate_id") % 3 == 0, "fact").when(F.col("candidate_id") % 5 == 0, "guess").otherwise("inference").alias("status"), F.posexplode(F.transform("source_post_ids", lambda x: T.post_id(x))).alias("pos", "id"))
    return each.join(known.withColumn("known", F.lit(True)), "id", "left")


def q_field_validation(spark, folder):
    """Citations of each field: kept if there are some, all of them are known, and its status is one of the two."""
    g = _fields(spark, folder).groupBy("candidate_id").agg(F.first("status").alias("status"), F.count("*").alias("n"), F.count("known").alias("n_known"))
    ok = F.col("status").isin("fact", "inference") & (F.col("n") == F.col("n_known"))
    return g.select("candidate_id", F.when(ok, F.col("status")).otherwise("unknown").alias("status"), F.when(ok, F.col("n")).otherwise(0).alias("n_ids"))


def q_analysis_merge(spark, folder):
    x = _fields(spark, folder).select(F.col("candidate_id").alias("ord"), (F.col("candidate_id") % 50).cast("string").alias("chunk_of"), F.coalesce("term", F.lit("")).alias("value"), F.col("id").alias("evidence_id"), "status")
    return C.merge_fields(x, ["chunk_of"]).select("chunk_of", "k", "value", "n_evidence", "first", "status")


# --- topics ------------------------------------------------------------------------------------------------------------
def _posts(spark, folder):
    return table(spark, folder, "posts").withColumn("community", T.community_key(F.col("subreddit")))


def _proposals(spark, folder):
    """Candidates as topic proposals, one for each community they name: community, prop_id, key and the posts they name."""
    k = table(spark, folder, "keyword_candidates").select("candidate_id", T.blank_to_null(T.keyword_norm(F.col("normalized_term"))).alias("key"), "source_post_ids", F.posexplode("communities").alias("at", "name"))
    k = k.select((F.col("candidate_id") * 100 + F.col("at")).alias("prop_id"), T.community_key(F.col("name")).alias("community"), "key", F.explode(F.array_distinct(F.transform("source_post_ids", lambda x: T.post_id(x)))).alias("post_id"))
    return k.filter("community IS NOT NULL AND key IS NOT NULL AND post_id IS NOT NULL")


def _members(spark, folder):
    p = _proposals(spark, folder)
    return p.join(table(spark, folder, "posts").select("post_id"), "post_id", "left_semi").withColumn("ord", F.col("prop_id"))


def _known(spark, folder):
    """All evidence there is: every comment of every thread."""
    return thread_comments(spark, folder).select("post_id", F.col("comment_id").alias("evidence_id"), "url")


def _refs(spark, folder):
    known = _known(spark, folder)
    p = _proposals(spark, folder).join(known, "post_id")
    bad = F.col("prop_id") % 11 == 0
    return p.select("prop_id", "post_id", F.when(bad, F.concat("evidence_id", F.lit("x"))).otherwise(F.col("evidence_id")).alias("evidence_id"), F.when(F.col("prop_id") % 13 == 0, " ").otherwise(F.col("key")).alias("claim"), F.lit("text").alias("translation"))


def q_evidence_validate(spark, folder):
    v = P.valid_evidence(_refs(spark, folder), _known(spark, folder))
    return v.groupBy("prop_id").agg(F.count("*").alias("n_refs"), F.bool_and("ok").alias("ok"))


def accepted(spark, folder):
    v = written(P.valid_evidence(_refs(spark, folder), _known(spark, folder)), "refs")
    return P.accept(_members(spark, folder), v)


def q_topic_cap(spark, folder):
    """Decision on every proposal, each post in at most three accepted ones of its community."""
    return accepted(spark, folder).select("community", "prop_id", "decision")


def topic_posts(spark, folder):
    return _members(spark, folder).select("community", "key", "post_id").distinct()


def counts(spark, folder):
    return P.counts(topic_posts(spark, folder), _posts(spark, folder), table(spark, folder, "comments"), commenters(spark, folder), AS_OF)


def q_topic_counts(spark, folder):
    return counts(spark, folder).select("community", "key", "topic_id", "status", "trend", "n_posts", "n_authors", "n_commenters", "n_participants", "n_comments", "upvotes", "n_current", "n_baseline")


def heated(spark, folder):
    return P.heat(counts(spark, folder))


def q_heat(spark, folder):
    return heated(spark, folder).select("community", "key", F.round(F.col("heat") * 100).cast("long").alias("heat100"))


def q_signal(spark, folder):
    x = P.signal(heated(spark, folder).withColumn("confidence", F.lit(0.5)), "confidence", "n_posts")
    return x.select("community", "key", F.round(F.col("signal") * 10).cast("long").alias("signal10"), "priority")


def q_metrics(spark, folder):
    t = counts(spark, folder)
    ev = _known(spark, folder).join(topic_posts(spark, folder).select("community", "post_id"), "post_id")
    return P.metrics(_posts(spark, folder), table(spark, folder, "comments"), commenters(spark, folder), t, topic_posts(spark, folder), ev)


def q_topic_ids(spark, folder):
    k = _proposals(spark, folder).select("community", "key", F.col("key").alias("label"), F.col("prop_id").alias("ord"))
    old = k.filter("ord % 4 = 0").select("community", "key", F.concat(F.lit("old "), "key").alias("label")).distinct()
    return L.register(old, k)


def q_graph_nodes(spark, folder):
    return P.graph(counts(spark, folder))[0]


def q_graph_edges(spark, folder):
    return P.graph(counts(spark, folder))[1]


# --- report sheets -----------------------------------------------------------------------------------------------------
def q_sheet_ranking(spark, folder):
    """Formal topics by heat with a running rank in their community."""
    from pyspark.sql.window import Window

    x = heated(spark, folder).filter("status = 'formal'")
    return x.select("community", F.row_number().over(Window.partitionBy("community").orderBy(F.col("heat").desc(), "key")).alias("rank"), "key", "trend", F.round(F.col("heat") * 100).cast("long").alias("heat100"))


def q_sheet_evidence(spark, folder):
    """One row for each topic and piece of evidence."""
    return topic_posts(spark, folder).join(_known(spark, folder), "post_id").select("community", "key", "post_id", "evidence_id", "url")


def q_sheet_communities(spark, folder):
    """All communities of the catalogue with their aliases and number of topics."""
    n = counts(spark, folder).groupBy("community").agg(F.count("*").alias("n_topics"), F.count(F.when(F.col("status") == "formal", 1)).alias("n_formal"))
    c = table(spark, folder, "communities").withColumn("community", T.community_key(F.col("name")))
    return c.join(n, "community", "left").select("community_id", "name", F.array_join("aliases", ", ").alias("aliases"), "category", "status", F.coalesce("n_topics", F.lit(0)).alias("n_topics"), F.coalesce("n_formal", F.lit(0)).alias("n_formal"))


def q_sheet_weak(spark, folder):
    return counts(spark, folder).filter("status = 'weak_signal'").select("community", "key", "n_posts", "n_authors")


def q_topic_search(spark, folder):
    """Topics whose row holds a text anywhere."""
    x = counts(spark, folder)
    return x.filter(F.contains(F.lower(F.to_json(F.struct("community", "key", "status", "trend"))), F.lit("pump"))).select("community", "key")


# --- libraries ---------------------------------------------------------------------------------------------------------
def _observed(spark, folder, old: bool):
    p = _posts(spark, folder).filter((F.year("created_at") < 2026) if old else (F.year("created_at") >= 2026))
    text = F.concat_ws(" ", "subreddit", "title", "body")
    own = p.select(F.col("community").alias("key"), "post_id", "author", L.in_domain(text, ANCHORS, EXCLUDED).alias("relevant"), F.lit("old" if old else "new").alias("run_id"), L.in_domain(text, EXCLUDED, []).alias("off_domain"))
    named = L.mentions(p.drop("community").withColumn("said", F.concat_ws(" ", "title", "body", F.regexp_replace("url", "^.*?(r/[^/]+).*$", " $1 "))), "said").select(F.col("community").alias("key"), "post_id", "author", L.in_domain(text, ANCHORS, EXCLUDED).alias("relevant"), F.lit("old" if old else "new").alias("run_id"), F.lit(False).alias("off_domain"))
    return own.unionByName(named)


def _community_library(spark, folder):
    old, new = _observed(spark, folder, True), _observed(spark, folder, False)
    ok = L.in_domain(F.col("key"), ANCHORS, EXCLUDED)
    m0 = L.community_members(old)
    none = spark.createDataFrame([], "key string, status string")
    prior = L.communities(none, old, m0, SEEDS, ok)
    return L.communities(prior, new, L.merge_members(m0, L.community_members(new)), SEEDS, ok)


def q_library_communities(spark, folder):
    return _community_library(spark, folder)


def q_active_communities(spark, folder):
    return L.active_communities(_community_library(spark, folder))


def q_mentions(spark, folder):
    p = table(spark, folder, "posts").withColumn("said", F.concat_ws(" ", "title", "body", F.regexp_replace("url", "^.*?(r/[^/]+).*$", " $1 ")))
    return L.mentions(p, "said").groupBy("community").agg(F.count("*").alias("n"))


def _library_keywords(spark, folder, old: bool):
    k = table(spark, folder, "keyword_candidates").withColumn("term", T.blank_to_null(T.keyword_norm(F.col("normalized_term")))).filter("term IS NOT NULL").filter((F.year("found_at") < 2026) if old else (F.year("found_at") >= 2026))
    return k.select("term", "status", F.coalesce("discovery_score", F.lit(0)).alias("score"), F.size(F.array_distinct(F.filter(F.transform("authors", lambda a: F.lower(F.trim(a))), lambda a: a != ""))).alias("n_authors"), "run_id", F.transform("source_post_ids", lambda x: T.post_id(x)).alias("ids"))


def q_library_keywords(spark, folder):
    old, new = _library_keywords(spark, folder, True), _library_keywords(spark, folder, False)
    both = old.unionByName(new)
    members = both.select("term", F.lit("post").alias("kind"), F.explode("ids").alias("id")).unionByName(both.select("term", F.lit("run").alias("kind"), F.col("run_id").alias("id"))).filter("id IS NOT NULL").distinct()
    x = L.keywords(old, new, members, K.searchable(F.col("term")))
    return x.select("term", "status", F.col("score_max").cast("long").alias("score_max"), F.col("author_max").cast("long").alias("author_max"), "n_post", "n_run")


def q_library_topics(spark, folder):
    t = heated(spark, folder).select(F.concat_ws("|", "community", "key").alias("key"), "topic_id", F.col("key").alias("label"), "status", "n_posts", "n_authors", F.round(F.col("heat") * 100).cast("long").alias("heat"), "n_current")
    t = written(t, "topics")
    return L.topics(t.filter("n_current = 0 OR n_posts > 3").drop("n_current"), t.filter("n_current > 0").withColumn("status", F.lit("weak_signal")).withColumn("heat", F.col("heat") - 1).drop("n_current"))


# --- evidence pools ----------------------------------------------------------------------------------------------------
def _pool_rows(spark, folder):
    d = table(spark, folder, "documents")
    return d.select(
        F.col("doc_id").alias("ord"), F.coalesce("source", F.lit("unknown")).alias("source"), F.col("doc_id").cast("string").alias("item_id"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("https://pool.example/"), (F.col("doc_id") - F.col("doc_id") % 3).cast("string"))).alias("url"),
        F.substring_index("text", "\n", 1).alias("title"), F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\\n') + 1)")).otherwise(F.when(F.col("text").isNotNull(), "")).alias("excerpt"), F.date_format("published_at", "yyyy-MM-dd").alias("published"), "author", T.first_nonzero(F.col("doc_id") % 4, F.col("n_chars") % 1000).alias("engagement"), (F.col("doc_id") % 17).alias("comments"),
    )


def q_evidence_pool(spark, folder):
    return O.pool(_pool_rows(spark, folder)).select("evidence_id", "source", "url", F.md5("title").alias("title"), F.md5("excerpt").alias("excerpt"), "published", "author", "engagement", "comments")


def _overview_refs(spark, folder):
    d = table(spark, folder, "documents")
    how = F.when(F.col("doc_id") % 3 == 0, F.concat_ws(":", "source", F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("https://pool.example/"), (F.col("doc_id") - F.col("doc_id") % 3).cast("string"), F.lit("/"))).otherwise(F.col("doc_id").cast("string"))
    return d.select(F.concat(F.coalesce("community", F.lit("none")), F.lit("-"), (F.col("doc_id") % 40).cast("string")).alias("topic"), how.alias("ref"))


def _resolved(spark, folder):
    pool = written(O.pool(_pool_rows(spark, folder)), "pool")
    return pool, O.resolve(_overview_refs(spark, folder), O.aliases(pool))


def q_overview_split(spark, folder):
    return O.split(_resolved(spark, folder)[1])


def q_sample_heat(spark, folder):
    pool, resolved = _resolved(spark, folder)
    return O.sample_heat(resolved, pool, date(2026, 6, 15), 8).select("topic", "n_evidence", "n_sources", "n_people", F.col("heat").cast("long").alias("heat"), "label")


def q_overlay(spark, folder):
    base = table(spark, folder, "posts").select("post_id", "title", F.coalesce("author", F.lit("")).alias("author"))
    richer = table(spark, folder, "post_batches").withColumn("post_id", T.post_id(F.col("post_id"))).filter("post_id IS NOT NULL").groupBy("post_id").agg(F.max("title").alias("title"), F.max("author").alias("author"))
    return O.overlay(base, richer, "post_id", ["title", "author"])


def q_cluster_labels(spark, folder):
    d = table(spark, folder, "documents").withColumn("label", F.explode(O.labels(F.coalesce("text", F.lit("")), LENSES)))
    return d.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("author").alias("n_authors"))


def q_user_history(spark, folder):
    """Comments, relevant ones and whether a user's history is of use (three relevant ones)."""
    c = table(spark, folder, "comments").withColumn("who", F.lower(F.trim("author"))).filter(F.coalesce("who", F.lit("")) != "")
    hit = F.col("body").rlike(r"(?i)\b(?:pump|turbo|injector)\b")
    return c.groupBy("who").agg(F.count("*").alias("n_comments"), F.count(F.when(hit, 1)).alias("n_relevant"), (F.count(F.when(hit, 1)) >= 3).alias("usable"))


QUERIES = {
    f.__name__: f
    for f in (q_thread_parse, q_thread_flatten, q_comment_chunks, q_fixed_chunks, q_commenters, q_sentences, q_voc_claims, q_voc_aggregate, q_voc_opportunity, q_voc_evidence, q_field_validation, q_analysis_merge, q_evidence_validate, q_topic_cap, q_topic_counts, q_heat, q_signal, q_metrics, q_topic_ids, q_graph_nodes, q_graph_edges, q_sheet_ranking, q_sheet_evidence, q_sheet_communities, q_sheet_weak, q_topic_search, q_library_communities, q_active_communities, q_mentions, q_library_keywords, q_library_topics, q_evidence_pool, q_overview_split, q_sample_heat, q_overlay, q_cluster_labels, q_user_history)
}

_ID = lambda x: f"CASE WHEN regexp_replace({_collapse(f'lower({x})')}, '^t3_', '') <> '' THEN 't3_' || regexp_replace({_collapse(f'lower({x})')}, '^t3_', '') END"
_KEY = lambda x: f"nullif(regexp_replace({_collapse(f'lower({x})')}, '^/?r/', ''), '')"
_TERM = "nullif(array_to_string(regexp_extract_all(lower(normalized_term), '[a-z0-9]+'), ' '), '')"
_THREAD = f"""
one AS (SELECT comment_id, arg_max(struct_pack(post_id, ord, body, url, author, parent_id, depth, score), struct_pack(a := coalesce(fetched_at, TIMESTAMP '1970-01-01'), b := coalesce(score, -1), c := ord)) AS r FROM comments GROUP BY 1),
flat AS (SELECT comment_id, r.* FROM one),
thread AS (SELECT f.post_id, f.ord, f.comment_id, {_collapse('f.body')} AS body, coalesce(nullif(trim(f.url), ''), {_url('p.url')} || '?comment=' || f.comment_id) AS url, coalesce(f.author, '') AS author,
  CASE WHEN f.parent_id IS NULL OR trim(f.parent_id) = '' OR starts_with(lower(trim(f.parent_id)), 't3_') THEN NULL ELSE regexp_replace(trim(f.parent_id), '^[tT]1_', '') END AS parent, greatest(coalesce(f.depth, 1), 1) AS depth, coalesce(f.score, 0) AS score
  FROM flat f LEFT JOIN posts p USING (post_id) WHERE {_collapse('f.body')} <> '')"""
_WHO = "who AS (SELECT DISTINCT c.post_id, lower(c.author) AS name FROM comments c LEFT JOIN posts p USING (post_id) WHERE trim(lower(c.author)) <> '' AND NOT coalesce(lower(c.author) = lower(p.author), false))"
_RULES = C.FIELDS
_Q = lambda p: p.replace("'", "''")
# The SQL engine has no lookahead: "broken in" is taken out of the sentence first.
_FITS = lambda k, p: (
    f"regexp_matches(regexp_replace(sentence, '(?i)\\bbroke?n?\\s+in', ' ', 'g'), '{_Q(p).replace('(?!' + chr(92) + 's+in)', '')}') AND NOT regexp_matches(sentence, '{C.NEGATED}')" if k == "pain" else f"regexp_matches(sentence, '{_Q(p)}')" + (f" AND regexp_matches(sentence, '{C.FIRST_PERSON}')" if k == "need" else "")
)
_START = lambda d: "CASE field " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items()) + " END"
_SAID = lambda p: _collapse(f"regexp_extract(sentence, '{_Q(p)}', 1)")
_PHRASE = "CASE " + " ".join(f"WHEN field = '{k}' AND regexp_matches(sentence, '{_Q(p)}') THEN '{before}' || CASE WHEN {_SAID(p)} <> '' THEN {_SAID(p)} ELSE '{without}' END" for k, (p, before, without) in C.CAPTURE.items()) + " ".join([""] + [f"WHEN regexp_matches(sentence, '{p}') THEN {_START(C.LABEL_START)} || '{name}'" for p, name in C.LABELS]) + f" WHEN {_collapse('sentence')} <> '' THEN {_START(C.EXCERPT_START)} || '：' || substr({_collapse('sentence')}, 1, 80) ELSE {_START(C.EXCERPT_START)} END"
_CLAIMS = _THREAD + f""", said AS (SELECT post_id, post_id AS evidence_id, coalesce(author, '') AS author, body AS text FROM posts UNION ALL SELECT post_id, comment_id, author, body FROM thread),
parts AS (SELECT post_id, evidence_id, author, unnest(list_transform(string_split(regexp_replace({_collapse("coalesce(text, '')")}, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda s, i: struct_pack(s := s, pos := i - 1))) AS x FROM said),
sent AS (SELECT post_id, evidence_id, author, x.pos AS pos, regexp_replace(regexp_replace(x.s, '^[ \\-—]+', ''), '[ \\-—]+$', '') AS sentence FROM parts WHERE length(trim(x.s)) >= 8),
raw_c AS ({' UNION ALL '.join(f"SELECT *, '{k}' AS field FROM sent WHERE " + _FITS(k, p) for k, p in _RULES.items())}),
marked AS (SELECT *, {_PHRASE} AS text, CASE WHEN regexp_matches(sentence, '{C.FIRST_PERSON}') THEN 'fact' ELSE 'inference' END AS status, CASE WHEN regexp_matches(sentence, '{C.HIGH}') THEN 'high' WHEN regexp_matches(sentence, '{C.MEDIUM}') THEN 'medium' ELSE 'unknown' END AS severity,
  CASE WHEN regexp_extract(sentence, '{C.BECAUSE}', 1) <> '' THEN {_collapse(f"regexp_extract(sentence, '{C.BECAUSE}', 1)")} ELSE 'unknown' END AS consequence FROM raw_c),
claims AS (SELECT post_id, evidence_id, field, text, sentence AS source_text, min(author) AS author, min(pos) AS pos, min(status) AS status, min(severity) AS severity, min(consequence) AS consequence FROM marked GROUP BY 1, 2, 3, 4, 5)"""
_HITS = lambda t: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({t}, '{p}') THEN '{n}' END" for n, p in LENSES) + "], lambda z: z IS NOT NULL)"
_AGG = _CLAIMS + f""", lensed AS (SELECT post_id, unnest(CASE WHEN len(h) > 0 THEN h[1:3] ELSE ['{LENSES[-1][0]}'] END) AS topic FROM (SELECT post_id, {_HITS("concat_ws(' ', title, body)")} AS h FROM posts)),
tc AS (SELECT * FROM claims JOIN lensed USING (post_id) WHERE list_contains({_HITS('source_text')}, topic)),
agg AS (SELECT topic, field, text, count(DISTINCT (post_id, evidence_id)) AS frequency, count(DISTINCT post_id) AS n_posts, count(DISTINCT nullif(lower(trim(author)), '')) AS n_authors, arg_min(source_text, struct_pack(a := post_id, b := evidence_id, c := pos)) AS source_text, CASE WHEN bool_and(status = 'fact') THEN 'fact' ELSE 'inference' END AS status,
  CASE max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'unknown' END AS severity, coalesce(arg_min(consequence, struct_pack(a := post_id, b := evidence_id, c := pos)) FILTER (consequence <> 'unknown'), 'unknown') AS consequence FROM tc GROUP BY 1, 2, 3)"""
_PROP = f"""
named_c AS (SELECT candidate_id, normalized_term, source_post_ids, unnest(communities) AS cname, generate_subscripts(communities, 1) - 1 AS place FROM keyword_candidates),
prop AS (SELECT DISTINCT prop_id, community, key, post_id FROM (SELECT candidate_id * 100 + place AS prop_id, {_KEY('cname')} AS community, {_TERM} AS key, unnest(list_transform(source_post_ids, lambda x: {_ID('x')})) AS post_id FROM named_c) WHERE community IS NOT NULL AND key IS NOT NULL AND post_id IS NOT NULL),
tp AS (SELECT DISTINCT community, key, post_id FROM prop WHERE post_id IN (SELECT post_id FROM posts))"""
_KNOWN = "known AS (SELECT post_id, comment_id AS evidence_id, url FROM thread)"
_COUNTS = _PROP + "," + _WHO + """, nc AS (SELECT post_id, count(DISTINCT comment_id) AS n FROM comments GROUP BY 1),
base AS (SELECT community, key, count(*) AS n_posts, count(DISTINCT nullif(author, '')) AS n_authors, sum(greatest(coalesce(score, 0), 0))::BIGINT AS upvotes, sum(coalesce(nc.n, 0))::BIGINT AS n_comments,
  count(*) FILTER (created_at >= TIMESTAMP '2026-06-15' - INTERVAL 30 DAY AND created_at <= TIMESTAMP '2026-06-15') AS n_current, count(*) FILTER (created_at >= TIMESTAMP '2026-06-15' - INTERVAL 90 DAY AND created_at < TIMESTAMP '2026-06-15' - INTERVAL 30 DAY) AS n_baseline
  FROM tp JOIN posts USING (post_id) LEFT JOIN nc USING (post_id) GROUP BY 1, 2),
people AS (SELECT community, key, name, true AS c FROM tp JOIN who USING (post_id) UNION ALL SELECT community, key, lower(author), false FROM tp JOIN posts USING (post_id) WHERE trim(coalesce(author, '')) <> ''),
crowd AS (SELECT community, key, count(*) FILTER (c) AS n_commenters, count(*) AS n_participants FROM (SELECT community, key, name, bool_or(c) AS c FROM people GROUP BY 1, 2, 3) GROUP BY 1, 2),
t0 AS (SELECT base.*, coalesce(n_commenters, 0) AS n_commenters, coalesce(n_participants, 0) AS n_participants FROM base LEFT JOIN crowd USING (community, key)),
t1 AS (SELECT *, CASE WHEN (n_posts >= 3 AND n_authors >= 3) OR (n_posts >= 2 AND n_commenters >= 10) THEN 'formal' ELSE 'weak_signal' END AS status FROM t0),
topics AS (SELECT *, CASE WHEN status = 'formal' AND n_current > 0 AND n_baseline = 0 THEN 'new' WHEN n_baseline = 0 THEN 'stable' WHEN (n_current * 2 - n_baseline) * 2 >= n_baseline THEN 'rising' WHEN (n_current * 2 - n_baseline) * 4 < -n_baseline THEN 'falling' ELSE 'stable' END AS trend,
  'topic_' || substr(sha256(community || ':' || key), 1, 16) AS topic_id FROM t1)"""
_PARTS = {"n_posts": (0.30, "n_posts::DOUBLE"), "n_authors": (0.20, "n_authors::DOUBLE"), "n_commenters": (0.20, "n_commenters::DOUBLE"), "upvotes": (0.15, "ln(1 + upvotes::DOUBLE)"), "growth": (0.15, "round(n_current / 30.0, 4) / greatest(round(n_baseline / 60.0, 4), 1 / 60.0::DOUBLE)")}
_HEAT = _COUNTS + f", heat AS (SELECT *, round(({' + '.join(f'{w}::DOUBLE * CASE WHEN max({e}) OVER (PARTITION BY community) > 0 THEN {e} / max({e}) OVER (PARTITION BY community) ELSE 0 END' for w, e in _PARTS.values())}) * 100, 2) AS heat FROM topics)"
_DOMAIN = lambda t: f"(regexp_matches(lower({t}), '{'|'.join(ANCHORS)}') AND NOT regexp_matches(lower({t}), '{'|'.join(EXCLUDED)}'))"
_SAY = "concat_ws(' ', title, body, regexp_replace(url, '^.*?(r/[^/]+).*$', ' \\1 '))"
_NAMED = f"SELECT *, unnest(list_distinct(list_transform(regexp_extract_all({_SAY}, '{L.MENTION}', 1), lambda x: lower(x)))) AS named FROM posts"
_OBS = f"""
obs AS (SELECT {_KEY('subreddit')} AS key, post_id, author, {_DOMAIN("concat_ws(' ', subreddit, title, body)")} AS relevant, CASE WHEN year(created_at) < 2026 THEN 'old' ELSE 'new' END AS run_id, regexp_matches(lower(concat_ws(' ', subreddit, title, body)), '{'|'.join(EXCLUDED)}') AS off FROM posts
  UNION ALL SELECT named, post_id, author, {_DOMAIN("concat_ws(' ', subreddit, title, body)")}, CASE WHEN year(created_at) < 2026 THEN 'old' ELSE 'new' END, false FROM ({_NAMED})),
n AS (SELECT key, r, count(DISTINCT post_id) FILTER (trim(post_id) <> '') AS n_post, count(DISTINCT author) FILTER (trim(author) <> '') AS n_author, count(DISTINCT post_id) FILTER (relevant) AS n_relevant, count(DISTINCT run_id) AS n_run FROM (SELECT *, 'all' AS r FROM obs UNION ALL SELECT *, 'first' FROM obs WHERE run_id = 'old') GROUP BY 1, 2),
o AS (SELECT key, bool_or(off) FILTER (run_id = 'old') AS off0, bool_or(off) FILTER (run_id = 'new') AS off1 FROM obs GROUP BY 1),
s0 AS (SELECT o.*, CASE WHEN off0 IS NULL THEN NULL WHEN o.key IN ('{"', '".join(SEEDS)}') THEN 'seed' WHEN off0 THEN 'quarantined' WHEN n_post >= 3 AND n_author >= 3 AND n_relevant >= 3 THEN 'active' ELSE 'observed' END AS was FROM o LEFT JOIN n ON n.key = o.key AND n.r = 'first'),
lib AS (SELECT s0.key, CASE WHEN s0.key IN ('{"', '".join(SEEDS)}') THEN 'seed' WHEN off1 IS NULL THEN was WHEN off1 THEN 'quarantined' WHEN coalesce(was, 'observed') = 'observed' AND n_post >= 3 AND n_author >= 3 AND n_relevant >= 3 THEN 'active' ELSE coalesce(was, 'observed') END AS status, n_post, n_author, n_relevant, n_run FROM s0 JOIN n ON n.key = s0.key AND n.r = 'all')"""
_LEVELS = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.STATUS.items()) + " ELSE 1 END"
_POOL = """
rows_p AS (SELECT doc_id AS ord, coalesce(source, 'unknown') AS source, doc_id::VARCHAR AS item_id, CASE WHEN doc_id % 5 <> 0 THEN 'https://pool.example/' || (doc_id - doc_id % 3)::VARCHAR END AS url, split_part(text, chr(10), 1) AS title, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) WHEN text IS NOT NULL THEN '' END AS excerpt, strftime(published_at, '%Y-%m-%d') AS published, author, coalesce(nullif(doc_id % 4, 0), nullif(n_chars % 1000, 0), 0) AS engagement, doc_id % 17 AS comments FROM documents),
kept AS (SELECT *, CASE WHEN coalesce(url, '') <> '' THEN 'url:' || url ELSE 'id:' || source || ':' || item_id END AS k FROM rows_p WHERE trim(coalesce(title, '')) <> '' OR trim(coalesce(excerpt, '')) <> ''),
pool AS (SELECT arg_min(source, ord) || ':' || arg_min(item_id, ord) AS evidence_id, arg_min(source, ord) AS source, arg_min(item_id, ord) AS item_id, coalesce(any_value(url), '') AS url, """ + ", ".join(f"arg_max(coalesce({c}, ''), struct_pack(a := length(coalesce({c}, '')), b := -ord)) AS {c}" for c in ("title", "excerpt", "published", "author")) + """, max(engagement) AS engagement, max(comments) AS comments FROM kept GROUP BY k)"""
_RES = _POOL + """, al AS (SELECT alias, arg_min(evidence_id, struct_pack(a := p, b := evidence_id)) AS evidence_id FROM (SELECT evidence_id AS alias, evidence_id, 0 AS p FROM pool UNION ALL SELECT url, evidence_id, 1 FROM pool UNION ALL SELECT item_id, evidence_id, 1 FROM pool) WHERE alias <> '' GROUP BY 1),
refs AS (SELECT coalesce(community, 'none') || '-' || (doc_id % 40)::VARCHAR AS topic, CASE doc_id % 3 WHEN 0 THEN concat_ws(':', source, doc_id::VARCHAR) WHEN 1 THEN 'https://pool.example/' || (doc_id - doc_id % 3)::VARCHAR || '/' ELSE doc_id::VARCHAR END AS ref FROM documents),
res AS (SELECT DISTINCT topic, coalesce(a.evidence_id, CASE WHEN ref LIKE 'http%' THEN b.evidence_id END) AS evidence_id FROM refs LEFT JOIN al a ON a.alias = ref LEFT JOIN al b ON b.alias = regexp_replace(ref, '/+$', '')), ok AS (SELECT * FROM res WHERE evidence_id IS NOT NULL)"""
_FLD = f"f AS (SELECT candidate_id, term, CASE WHEN candidate_id % 3 = 0 THEN 'fact' WHEN candidate_id % 5 = 0 THEN 'guess' ELSE 'inference' END AS status, unnest(list_transform(source_post_ids, lambda x: {_ID('x')})) AS id FROM keyword_candidates)"
_KW = f"k AS (SELECT {_TERM} AS term, status, coalesce(discovery_score, 0) AS score, len(list_distinct(list_filter(list_transform(authors, lambda a: lower(trim(a))), lambda a: a <> ''))) AS n_authors, run_id, source_post_ids, year(found_at) < 2026 AS old FROM keyword_candidates WHERE {_TERM} IS NOT NULL)"
ORACLE = {
    "q_thread_parse": "WITH " + _THREAD + " SELECT post_id, ord, comment_id, url, coalesce(parent, '') AS parent, depth::BIGINT AS depth, score, length(body) AS chars FROM thread",
    "q_thread_flatten": "WITH RECURSIVE " + _THREAD + f""", ranked AS (SELECT post_id, comment_id, parent, row_number() OVER (PARTITION BY post_id, coalesce(parent, '') ORDER BY score DESC, ord, comment_id) AS rank FROM thread QUALIFY rank <= {REPLIES}),
tree AS (SELECT post_id, comment_id, 1::BIGINT AS level, lpad(rank::VARCHAR, 5, '0') AS path FROM ranked WHERE parent IS NULL UNION ALL SELECT r.post_id, r.comment_id, t.level + 1, t.path || '/' || lpad(r.rank::VARCHAR, 5, '0') FROM tree t JOIN ranked r ON r.parent = t.comment_id AND r.post_id = t.post_id WHERE t.level < {LEVELS})
SELECT post_id, comment_id, level, path FROM tree""",
    "q_comment_chunks": "WITH RECURSIVE " + _THREAD + f""", s AS (SELECT post_id, length(body) + length(url) + 256 AS size, row_number() OVER (PARTITION BY post_id ORDER BY ord, comment_id) AS i FROM thread),
w AS (SELECT post_id, i, 1 AS chunk, size AS total, size FROM s WHERE i = 1 UNION ALL SELECT s.post_id, s.i, CASE WHEN w.total + s.size > {CHUNK} THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.total + s.size > {CHUNK} THEN s.size ELSE w.total + s.size END, s.size FROM w JOIN s ON s.post_id = w.post_id AND s.i = w.i + 1)
SELECT post_id, chunk, count(*) AS n_comments, sum(size)::BIGINT AS size FROM w GROUP BY 1, 2""",
    "q_fixed_chunks": "WITH k AS (SELECT run_id, candidate_id, (row_number() OVER (PARTITION BY run_id ORDER BY candidate_id) - 1) // 8 AS chunk FROM keyword_candidates) SELECT run_id, chunk, count(*) AS n, min(candidate_id) AS first_id FROM k GROUP BY 1, 2",
    "q_commenters": "WITH " + _WHO + " SELECT post_id, count(*) AS n_commenters FROM who GROUP BY 1",
    "q_sentences": f"WITH p AS (SELECT unnest(string_split(regexp_replace({_collapse(chr(99) + 'oalesce(body, ' + chr(39) * 2 + ')')}, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS s FROM posts) SELECT regexp_replace(regexp_replace(s, '^[ \\-—]+', ''), '[ \\-—]+$', '') AS sentence, count(*) AS n FROM p WHERE length(trim(s)) >= 8 GROUP BY 1",
    "q_voc_claims": "WITH " + _CLAIMS + " SELECT field, status, severity, count(*) AS n, count(DISTINCT post_id) AS n_posts FROM claims GROUP BY 1, 2, 3",
    "q_voc_aggregate": "WITH " + _AGG + " SELECT * FROM agg",
    "q_voc_opportunity": "WITH " + _AGG + " SELECT topic, text, frequency, n_posts, n_authors FROM agg WHERE field = 'solution_gap' AND n_posts >= 2 AND n_authors >= 2 AND topic IN (SELECT topic FROM agg WHERE field = 'pain' AND n_authors >= 2) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n_posts DESC, frequency DESC, text) = 1",
    "q_voc_evidence": "WITH " + _CLAIMS + f", known AS (SELECT post_id, comment_id AS evidence_id, url FROM thread UNION ALL SELECT post_id, post_id, {_url('url')} FROM posts), c AS (SELECT DISTINCT post_id, evidence_id FROM claims), e AS (SELECT DISTINCT post_id, evidence_id, url FROM c JOIN known USING (post_id, evidence_id) WHERE coalesce(url, '') <> '') SELECT post_id, count(*) AS n_evidence, min(url) AS first_url FROM e GROUP BY 1",
    "q_field_validation": "WITH " + _FLD + " SELECT candidate_id, CASE WHEN any_value(status) IN ('fact', 'inference') AND count(*) = count(p.post_id) THEN any_value(status) ELSE 'unknown' END AS status, CASE WHEN any_value(status) IN ('fact', 'inference') AND count(*) = count(p.post_id) THEN count(*) ELSE 0 END AS n_ids FROM f LEFT JOIN posts p ON p.post_id = f.id GROUP BY 1",
    "q_analysis_merge": "WITH " + _FLD + " SELECT (candidate_id % 50)::VARCHAR AS chunk_of, lower(trim(coalesce(term, ''))) AS k, arg_min(coalesce(term, ''), candidate_id) AS value, count(DISTINCT id) AS n_evidence, min(candidate_id) AS first, CASE max(CASE status WHEN 'fact' THEN 2 WHEN 'inference' THEN 1 ELSE 0 END) WHEN 2 THEN 'fact' WHEN 1 THEN 'inference' ELSE 'unknown' END AS status FROM f GROUP BY 1, 2",
    "q_evidence_validate": "WITH " + _THREAD + "," + _PROP + "," + _KNOWN + " SELECT prop_id, count(DISTINCT post_id) AS n_refs, bool_and(prop_id % 11 <> 0 AND prop_id % 13 <> 0 AND regexp_matches(url, '^https?://')) AS ok FROM prop JOIN known USING (post_id) GROUP BY 1",
    "q_topic_counts": "WITH " + _COUNTS + " SELECT community, key, topic_id, status, trend, n_posts, n_authors, n_commenters, n_participants, n_comments, upvotes, n_current, n_baseline FROM topics",
    "q_heat": "WITH " + _HEAT + " SELECT community, key, round(heat * 100)::BIGINT AS heat100 FROM heat",
    "q_signal": "WITH " + _HEAT + ", s AS (SELECT *, least(greatest(round(heat / 100 * 4 + 0.5::DOUBLE * 3 + least(1.0, n_posts / 12.0) * 2 + CASE WHEN status = 'formal' THEN 1.0 ELSE 0.3 END::DOUBLE, 1), 0), 10) AS signal FROM heat) SELECT community, key, round(signal * 10)::BIGINT AS signal10, CASE WHEN status = 'formal' AND signal >= 7 THEN 'priority_validate' WHEN status = 'formal' THEN 'validate' WHEN signal >= 3 THEN 'observe' ELSE 'skip' END AS priority FROM s",
    "q_metrics": "WITH " + _THREAD + "," + _COUNTS + "," + _KNOWN + f""", pc AS (SELECT post_id, {_KEY('subreddit')} AS community, CASE WHEN lower(trim(author)) NOT IN ('[deleted]', 'deleted', 'none', '') THEN lower(trim(author)) END AS author FROM posts),
cn AS (SELECT community, CASE WHEN lower(trim(name)) NOT IN ('[deleted]', 'deleted', 'none', '') THEN lower(trim(name)) END AS x FROM who JOIN pc USING (post_id)),
pairs AS (SELECT 'n_posts' AS metric, community, post_id AS x FROM pc UNION SELECT 'n_post_authors', community, author FROM pc UNION SELECT 'n_commenters', community, x FROM cn UNION SELECT 'n_participants', community, author FROM pc UNION SELECT 'n_participants', community, x FROM cn
  UNION SELECT 'n_comments', community, comment_id FROM comments JOIN pc USING (post_id) UNION SELECT 'n_topics', community, community || '|' || key FROM topics UNION SELECT 'n_formal_topics', community, community || '|' || key FROM topics WHERE status = 'formal'
  UNION SELECT 'n_topic_posts', community, post_id FROM tp UNION SELECT 'n_evidence', tp.community, concat_ws('|', post_id, evidence_id, url) FROM known JOIN tp USING (post_id)), good AS (SELECT * FROM pairs WHERE x IS NOT NULL AND community IS NOT NULL)
SELECT metric, community, count(*) AS n FROM good GROUP BY 1, 2 UNION ALL SELECT metric, 'all', count(DISTINCT x) FROM good GROUP BY 1""",
    "q_topic_ids": "WITH " + _PROP + ", o AS (SELECT DISTINCT community, key FROM prop WHERE prop_id % 4 = 0) SELECT k.community, k.key, CASE WHEN o.key IS NULL THEN k.key ELSE 'old ' || k.key END AS label, 'topic_' || substr(sha256(k.community || ':' || k.key), 1, 16) AS topic_id FROM (SELECT DISTINCT community, key FROM prop) k LEFT JOIN o ON o.community = k.community AND o.key = k.key",
    "q_graph_nodes": "WITH " + _COUNTS + " SELECT DISTINCT 'community:' || community AS id, 'community' AS type, community AS label FROM topics WHERE status = 'formal' UNION ALL SELECT topic_id, 'topic', key FROM topics WHERE status = 'formal'",
    "q_graph_edges": "WITH " + _COUNTS + " SELECT 'community:' || community AS source, topic_id AS target FROM topics WHERE status = 'formal'",
    "q_sheet_ranking": "WITH " + _HEAT + " SELECT community, row_number() OVER (PARTITION BY community ORDER BY heat DESC, key) AS rank, key, trend, round(heat * 100)::BIGINT AS heat100 FROM heat WHERE status = 'formal'",
    "q_sheet_evidence": "WITH " + _THREAD + "," + _PROP + "," + _KNOWN + " SELECT community, key, post_id, evidence_id, url FROM tp JOIN known USING (post_id)",
    "q_sheet_communities": "WITH " + _COUNTS + f", n AS (SELECT community, count(*) AS n_topics, count(*) FILTER (status = 'formal') AS n_formal FROM topics GROUP BY 1) SELECT community_id, name, array_to_string(aliases, ', ') AS aliases, category, status, coalesce(n_topics, 0) AS n_topics, coalesce(n_formal, 0) AS n_formal FROM communities c LEFT JOIN n ON n.community = {_KEY('c.name')}",
    "q_sheet_weak": "WITH " + _COUNTS + " SELECT community, key, n_posts, n_authors FROM topics WHERE status = 'weak_signal'",
    "q_topic_search": "WITH " + _COUNTS + " SELECT community, key FROM topics WHERE concat_ws(' ', community, key, status, trend) LIKE '%pump%'",
    "q_library_communities": "WITH " + _OBS + " SELECT key, status, n_post, n_author, n_relevant, n_run FROM lib",
    "q_active_communities": "WITH " + _OBS + " SELECT key FROM lib WHERE status = 'seed' OR (status = 'active' AND n_post >= 3 AND n_author >= 3 AND n_relevant >= 3)",
    "q_mentions": f"SELECT named AS community, count(*) AS n FROM ({_NAMED}) GROUP BY 1",
    "q_library_keywords": "WITH " + _KW + f""", side AS (SELECT term, old, arg_max(lower(status), {_LEVELS('lower(status)')}) AS status, max({_LEVELS('lower(status)')}) AS level, max(score) AS score, max(n_authors) AS n_authors FROM k GROUP BY 1, 2),
a AS (SELECT * FROM side WHERE old), b AS (SELECT * FROM side WHERE NOT old AND {_search('term')}), n AS (SELECT term, count(DISTINCT id) FILTER (id IS NOT NULL) AS n_post, count(DISTINCT run_id) AS n_run FROM (SELECT term, run_id, unnest(CASE WHEN len(source_post_ids) > 0 THEN list_transform(source_post_ids, lambda x: {_ID('x')}) ELSE [NULL] END) AS id FROM k) GROUP BY 1),
j AS (SELECT coalesce(a.term, b.term) AS term, CASE WHEN a.term IS NOT NULL AND NOT {_search('a.term')} THEN 'quarantined' ELSE coalesce(a.status, 'observed') END AS was, b.status AS now, greatest(a.score, b.score) AS score_max, greatest(a.n_authors, b.n_authors) AS author_max FROM a FULL OUTER JOIN b ON a.term = b.term),
s AS (SELECT j.*, coalesce(n_post, 0) AS n_post, coalesce(n_run, 0) AS n_run, CASE WHEN now IS NULL THEN was WHEN {_LEVELS('now')} > {_LEVELS('was')} THEN now ELSE was END AS st FROM j LEFT JOIN n ON n.term = j.term)
SELECT term, CASE WHEN now IS NOT NULL AND st NOT IN ('rejected', 'disabled', 'quarantined') AND n_post >= 2 AND author_max >= 2 AND score_max >= 20 THEN 'active' ELSE st END AS status, score_max::BIGINT AS score_max, author_max, n_post, n_run FROM s""",
    "q_library_topics": "WITH " + _HEAT + """, t AS (SELECT community || '|' || key AS key, topic_id, key AS label, status, n_posts, n_authors, round(heat * 100)::BIGINT AS heat, n_current FROM heat), a AS (SELECT * FROM t WHERE n_current = 0 OR n_posts > 3), b AS (SELECT * REPLACE ('weak_signal' AS status, heat - 1 AS heat) FROM t WHERE n_current > 0)
SELECT coalesce(a.key, b.key) AS key, coalesce(a.topic_id, b.topic_id) AS topic_id, coalesce(b.label, a.label) AS label, CASE WHEN a.status = 'formal' OR b.status = 'formal' THEN 'formal' ELSE 'weak_signal' END AS status, coalesce(b.n_posts, a.n_posts) AS n_posts_latest, greatest(a.n_authors, b.n_authors) AS n_authors_max, greatest(a.heat, b.heat) AS heat_max FROM a FULL OUTER JOIN b ON a.key = b.key""",
    "q_evidence_pool": "WITH " + _POOL + " SELECT evidence_id, source, url, md5(title) AS title, md5(excerpt) AS excerpt, published, author, engagement, comments FROM pool",
    "q_overview_split": "WITH " + _RES + " SELECT topic, count(*) AS n_evidence, CASE WHEN count(*) >= 3 THEN 'topics' ELSE 'watchlist' END AS place FROM ok GROUP BY 1",
    "q_sample_heat": "WITH " + _RES + """, g AS (SELECT topic, count(*) AS n, sum(ln(1 + greatest(engagement, 0)::DOUBLE)) AS e, count(DISTINCT source) AS s, coalesce(avg(greatest(0, least(1, 1 - greatest(0, date_diff('day', TRY_CAST(published AS DATE), DATE '2026-06-15')) / 30.0::DOUBLE))), 0) AS r, count(DISTINCT CASE WHEN lower(trim(author)) NOT IN ('unknown', '未知', 'anonymous', '匿名', '') THEN lower(trim(author)) END) AS p FROM ok JOIN pool USING (evidence_id) GROUP BY 1),
h AS (SELECT *, greatest(0, least(100, round_even(100 * (0.35::DOUBLE * n / greatest(max(n) OVER (), 1) + 0.25::DOUBLE * CASE WHEN max(e) OVER () > 0 THEN e / max(e) OVER () ELSE 0 END + 0.2::DOUBLE * s / 8 + 0.2::DOUBLE * r), 0)))::BIGINT AS heat FROM g)
SELECT topic, n AS n_evidence, s AS n_sources, p AS n_people, heat, CASE WHEN heat >= 70 THEN 'high' WHEN heat >= 40 THEN 'medium' ELSE 'low' END AS label FROM h""",
    "q_overlay": f"WITH r AS (SELECT {_ID('post_id')} AS pid, max(title) AS title, max(author) AS author FROM post_batches GROUP BY 1) SELECT p.post_id, coalesce(nullif(trim(r.title), ''), p.title) AS title, coalesce(nullif(trim(r.author), ''), coalesce(p.author, '')) AS author FROM posts p LEFT JOIN r ON r.pid = p.post_id",
    "q_cluster_labels": "WITH x AS (SELECT author, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}' END" for n, p in LENSES) + "], lambda z: z IS NOT NULL) AS h FROM documents), y AS (SELECT author, unnest(CASE WHEN len(h) > 0 THEN h[1:3] ELSE ['other'] END) AS label FROM x) SELECT label, count(*) AS n, count(DISTINCT author) AS n_authors FROM y GROUP BY 1",
    "q_user_history": r"SELECT lower(trim(author)) AS who, count(*) AS n_comments, count(*) FILTER (regexp_matches(body, '(?i)\b(?:pump|turbo|injector)\b')) AS n_relevant, count(*) FILTER (regexp_matches(body, '(?i)\b(?:pump|turbo|injector)\b')) >= 3 AS usable FROM comments WHERE lower(trim(author)) <> '' GROUP BY 1",
}
