"""Projections, set operations and small merges behind reports and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import text as T
from tallyforge.operators import overview as O
from tallyforge.plans import evidence_queries as E
from tallyforge.plans.listing_queries import _collapse
from tallyforge.sources.tables import table


def q_sheet_overview(spark, folder):
    """The wide row of each topic."""
    x = E.heated(spark, folder)
    return x.select("topic_id", "community", "key", "status", "trend", "n_posts", "n_authors", "n_commenters", "n_participants", "n_comments", "upvotes", F.round(F.col("n_current") / 30 * 10000).cast("long").alias("rate_now"), F.round(F.col("n_baseline") / 60 * 10000).cast("long").alias("rate_before"), F.round(F.col("heat") * 100).cast("long").alias("heat100"))


def q_sheet_keywords(spark, folder):
    k = table(spark, folder, "keyword_candidates")
    return k.select("candidate_id", F.coalesce("term", F.lit("")).alias("term"), F.array_join("categories", ", ").alias("categories"), F.array_join("extraction_methods", ", ").alias("methods"), F.size("source_post_ids").cast("long").alias("n_posts"), F.coalesce("discovery_score", F.lit(0)).cast("long").alias("score"), "status")


def q_sheet_excluded(spark, folder):
    """Proposals that became no topic, and why."""
    return E.accepted(spark, folder).filter("decision <> 'accepted'").groupBy("community", "decision").agg(F.count("*").alias("n"))


def q_evidence_browser(spark, folder):
    """The first eight pieces of evidence of each topic."""
    x = E.q_sheet_evidence(spark, folder)
    w = Window.partitionBy("community", "key").orderBy("post_id", "evidence_id")
    return x.withColumn("n", F.row_number().over(w)).filter("n <= 8").select("community", "key", "n", "evidence_id")


def q_field_topics(spark, folder):
    """Up to three labels with citations of each analysis."""
    k = table(spark, folder, "keyword_candidates")
    keep = F.slice(F.filter("categories", lambda c: F.trim(c) != ""), 1, 3)
    ok = (F.trim(F.coalesce("term", F.lit(""))) != "") & (F.size("source_post_ids") > 0)
    return k.select("candidate_id", F.when(ok, F.array_join(keep, ",")).otherwise("").alias("topics"))


def q_source_status(spark, folder):
    """Documents of each wanted source and whether any came; the run is degraded if one has none."""
    t = table(spark, folder, "mix_targets").select("source")
    n = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"))
    j = t.join(n, "source", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("source", "n", F.when(F.col("n") > 0, "ok").otherwise("no-results").alias("state"))


def q_run_state(spark, folder):
    return q_source_status(spark, folder).agg(F.when(F.bool_and(F.col("state") == "ok"), "completed").otherwise("degraded").alias("state"))


def q_claim_recurrence(spark, folder):
    """Posts and authors behind each claim text of a community."""
    c = E.claims(spark, folder).join(E._posts(spark, folder).select("post_id", "community"), "post_id")
    return c.groupBy("community", "field", "text").agg(F.count_distinct("post_id").alias("n_posts"), F.count_distinct(F.lower(T.blank_to_null(F.col("author")))).alias("n_authors"), F.count("*").alias("frequency")).filter("n_posts >= 2")


def q_proposal_merge(spark, folder):
    """Proposals of one key merged across chunks, in every community they name: the first labels, all posts, the highest confidence."""
    k = table(spark, folder, "keyword_candidates").withColumn("community", F.explode("communities")).withColumn("community", T.community_key(F.col("community"))).withColumn("key", F.lower(F.trim("term"))).filter("community IS NOT NULL AND key <> ''")
    posts = k.select("community", "key", F.explode_outer("source_post_ids").alias("p")).groupBy("community", "key").agg(F.count_distinct(T.post_id(F.col("p"))).alias("n_posts"))
    head = k.groupBy("community", "key").agg(F.min_by("term", "candidate_id").alias("label"), F.max("discovery_score").alias("confidence"), F.count_distinct("candidate_id").alias("n_chunks"))
    return head.join(posts, ["community", "key"]).select("community", "key", "label", F.coalesce("confidence", F.lit(0)).cast("long").alias("confidence"), "n_chunks", "n_posts")


def q_slang_suggestions(spark, folder):
    """Topic labels that a community's list of terms lacks."""
    known = table(spark, folder, "communities").select(T.community_key(F.col("name")).alias("community"), F.explode("include_terms").alias("key")).select("community", T.keyword_norm(F.col("key")).alias("key"))
    return E.topic_posts(spark, folder).select("community", "key").distinct().join(known, ["community", "key"], "left_anti")


def q_next_communities(spark, folder):
    """Communities of the next run: the catalogue's approved ones and active discoveries."""
    have = table(spark, folder, "communities").filter("status = 'approved'").select(T.community_key(F.col("name")).alias("community"), F.lit("catalogue").alias("origin"))
    new = E.q_active_communities(spark, folder).select(F.col("key").alias("community")).join(have.select("community"), "community", "left_anti")
    return have.unionByName(new.select("community", F.lit("discovered").alias("origin")))


def q_set_operations(spark, folder):
    """Communities only in the catalogue, only in posts, and in both."""
    a = table(spark, folder, "communities").select(T.community_key(F.col("name")).alias("c"))
    b = E._posts(spark, folder).select(F.col("community").alias("c")).filter("c IS NOT NULL")
    tag = lambda df, t: df.select("c", F.lit(t).alias("where"))
    return tag(a.exceptAll(b.distinct()), "catalogue").unionByName(tag(b.subtract(a), "posts")).unionByName(tag(a.intersect(b), "both"))


def q_rule_topics(spark, folder):
    """Lenses of each post's own text (at most three, the last one where none fits) and the confidence of each lens."""
    p = E._posts(spark, folder).withColumn("lens", F.explode(O.labels(F.concat_ws(" ", "title", "body"), E.LENSES)))
    c = table(spark, folder, "comments").groupBy("post_id").agg(F.count_distinct("comment_id").alias("k"))
    g = p.join(c, "post_id", "left").groupBy("community", "lens").agg(F.count_distinct("post_id").alias("n_posts"), F.sum(F.coalesce("k", F.lit(0))).alias("n_comments"))
    sure = F.least(F.lit(8800), 3500 + F.col("n_posts") * 800 + F.least(F.col("n_comments"), F.lit(20)) * 100)
    return g.select("community", "lens", "n_posts", "n_comments", sure.cast("long").alias("confidence10000"))


def q_record_signal(spark, folder):
    """A simple strength of each thread from its replies."""
    n = table(spark, folder, "comments").groupBy("post_id").agg(F.count_distinct("comment_id").alias("c"))
    s = F.least(F.lit(100), 35 + F.least(F.col("comment_count"), F.lit(35)) + F.least(F.coalesce("c", F.lit(0)), F.lit(20)) + F.when(F.coalesce("c", F.lit(0)) >= 5, 10).otherwise(0))
    return table(spark, folder, "posts").join(n, "post_id", "left").select("post_id", s.cast("long").alias("signal"))


def q_url_lookup(spark, folder):
    """Posts found again by the url a comment was read at."""
    c = table(spark, folder, "comments").filter(F.trim("url") != "").select("comment_id", T.canonical_url(F.col("url"), "https://forum.example").alias("url")).distinct()
    p = table(spark, folder, "posts").select("post_id", T.canonical_url(F.col("url"), "https://forum.example").alias("url"))
    return c.join(p, "url").groupBy("post_id").agg(F.count_distinct("comment_id").alias("n_comments"))


def q_representatives(spark, folder):
    """The first three members of each cluster (community) in their order, with their titles."""
    k = E._posts(spark, folder).withColumn("n", F.row_number().over(Window.partitionBy("community").orderBy(F.col("score").desc_nulls_last(), "post_id"))).filter("n <= 3")
    return k.select("community", "n", "post_id", "title")


def q_run_counters(spark, folder):
    """Rows of each stage of a run."""
    stages = {"posts": table(spark, folder, "posts"), "batches": table(spark, folder, "post_batches"), "comments": table(spark, folder, "comments"), "candidates": table(spark, folder, "keyword_candidates"), "topics": E.topic_posts(spark, folder).select("community", "key").distinct()}
    out = None
    for k, df in stages.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    f.__name__: f
    for f in (q_sheet_overview, q_sheet_keywords, q_sheet_excluded, q_evidence_browser, q_field_topics, q_source_status, q_run_state, q_claim_recurrence, q_proposal_merge, q_slang_suggestions, q_next_communities, q_set_operations, q_rule_topics, q_record_signal, q_url_lookup, q_representatives, q_run_counters)
}

_U = "'https://forum.example'"
_COMM = lambda c: f"nullif(regexp_replace({_collapse(f'lower({c})')}, '^/?r/', ''), '')"
_SRC = "s AS (SELECT t.source, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) > 0 THEN 'ok' ELSE 'no-results' END AS state FROM mix_targets t LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) d ON d.source = t.source)"
_LENS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{n}' END" for n, p in E.LENSES) + "], lambda z: z IS NOT NULL)"
ORACLE = {
    "q_sheet_overview": "WITH " + E._HEAT + " SELECT topic_id, community, key, status, trend, n_posts, n_authors, n_commenters, n_participants, n_comments, upvotes, round(n_current / 30.0::DOUBLE * 10000)::BIGINT AS rate_now, round(n_baseline / 60.0::DOUBLE * 10000)::BIGINT AS rate_before, round(heat * 100)::BIGINT AS heat100 FROM heat",
    "q_sheet_keywords": "SELECT candidate_id, coalesce(term, '') AS term, array_to_string(categories, ', ') AS categories, array_to_string(extraction_methods, ', ') AS methods, len(source_post_ids) AS n_posts, coalesce(discovery_score, 0)::BIGINT AS score, status FROM keyword_candidates",
    "q_evidence_browser": "WITH " + E._THREAD + "," + E._PROP + "," + E._KNOWN + " SELECT community, key, row_number() OVER (PARTITION BY community, key ORDER BY post_id, evidence_id) AS n, evidence_id FROM tp JOIN known USING (post_id) QUALIFY n <= 8",
    "q_field_topics": "SELECT candidate_id, CASE WHEN trim(coalesce(term, '')) <> '' AND len(source_post_ids) > 0 THEN array_to_string(list_filter(categories, lambda c: trim(c) <> '')[1:3], ',') ELSE '' END AS topics FROM keyword_candidates",
    "q_source_status": "WITH " + _SRC + " SELECT * FROM s",
    "q_run_state": "WITH " + _SRC + " SELECT CASE WHEN bool_and(state = 'ok') THEN 'completed' ELSE 'degraded' END AS state FROM s",
    "q_claim_recurrence": "WITH " + E._CLAIMS + f" SELECT {_COMM('p.subreddit')} AS community, field, c.text, count(DISTINCT c.post_id) AS n_posts, count(DISTINCT lower(nullif(c.author, ''))) AS n_authors, count(*) AS frequency FROM claims c JOIN posts p USING (post_id) GROUP BY 1, 2, 3 HAVING count(DISTINCT c.post_id) >= 2",
    "q_proposal_merge": f"WITH k0 AS (SELECT *, unnest(communities) AS cname FROM keyword_candidates), k AS (SELECT candidate_id, {_COMM('cname')} AS community, lower(trim(term)) AS key, term, discovery_score, source_post_ids FROM k0), g AS (SELECT * FROM k WHERE community IS NOT NULL AND key <> ''), p AS (SELECT community, key, unnest(CASE WHEN len(source_post_ids) > 0 THEN source_post_ids ELSE [NULL] END) AS p FROM g), n AS (SELECT community, key, count(DISTINCT {E._ID('p')}) AS n_posts FROM p GROUP BY 1, 2), h AS (SELECT community, key, arg_min(term, candidate_id) AS label, coalesce(max(discovery_score), 0)::BIGINT AS confidence, count(DISTINCT candidate_id) AS n_chunks FROM g GROUP BY 1, 2) SELECT h.community, h.key, label, confidence, n_chunks, n_posts FROM h JOIN n USING (community, key)",
    "q_slang_suggestions": "WITH " + E._PROP + f", known AS (SELECT {_COMM('name')} AS community, array_to_string(regexp_extract_all(lower(t), '[a-z0-9]+'), ' ') AS key FROM (SELECT name, unnest(include_terms) AS t FROM communities)) SELECT DISTINCT community, key FROM tp WHERE (community, key) NOT IN (SELECT (community, key) FROM known)",
    "q_next_communities": "WITH " + E._OBS + f", have AS (SELECT {_COMM('name')} AS community FROM communities WHERE status = 'approved') SELECT community, 'catalogue' AS origin FROM have UNION ALL SELECT key, 'discovered' FROM lib WHERE (status = 'seed' OR (status = 'active' AND n_post >= 3 AND n_author >= 3 AND n_relevant >= 3)) AND key NOT IN (SELECT community FROM have)",
    "q_set_operations": f"""WITH a AS (SELECT {_COMM('name')} AS c FROM communities), b AS (SELECT DISTINCT {_COMM('subreddit')} AS c FROM posts) SELECT c, 'catalogue' AS "where" FROM a WHERE c NOT IN (SELECT c FROM b WHERE c IS NOT NULL) UNION ALL SELECT c, 'posts' FROM b WHERE c IS NOT NULL AND c NOT IN (SELECT c FROM a) UNION ALL SELECT DISTINCT c, 'both' FROM a WHERE c IN (SELECT c FROM b)""",
    "q_rule_topics": f"WITH x AS (SELECT post_id, {_COMM('subreddit')} AS community, concat_ws(' ', title, body) AS t FROM posts), y AS (SELECT post_id, community, {_LENS} AS h FROM x), z AS (SELECT post_id, community, unnest(CASE WHEN len(h) > 0 THEN h[1:3] ELSE ['other'] END) AS lens FROM y), c AS (SELECT post_id, count(DISTINCT comment_id) AS k FROM comments GROUP BY 1), g AS (SELECT community, lens, count(DISTINCT post_id) AS n_posts, sum(coalesce(k, 0))::BIGINT AS n_comments FROM z LEFT JOIN c USING (post_id) GROUP BY 1, 2) SELECT *, least(8800, 3500 + n_posts * 800 + least(n_comments, 20) * 100)::BIGINT AS confidence10000 FROM g",
    "q_record_signal": "WITH n AS (SELECT post_id, count(DISTINCT comment_id) AS c FROM comments GROUP BY 1) SELECT post_id, least(100, 35 + least(comment_count, 35) + least(coalesce(c, 0), 20) + CASE WHEN coalesce(c, 0) >= 5 THEN 10 ELSE 0 END)::BIGINT AS signal FROM posts LEFT JOIN n USING (post_id)",
    "q_url_lookup": f"WITH c AS (SELECT DISTINCT comment_id, {E._url('url')} AS url FROM comments WHERE trim(url) <> ''), p AS (SELECT post_id, {E._url('url')} AS url FROM posts) SELECT post_id, count(DISTINCT comment_id) AS n_comments FROM c JOIN p USING (url) GROUP BY 1",
    "q_representatives": f"SELECT {_COMM('subreddit')} AS community, row_number() OVER (PARTITION BY {_COMM('subreddit')} ORDER BY score DESC NULLS LAST, post_id) AS n, post_id, title FROM posts QUALIFY n <= 3",
    "q_run_counters": "WITH " + E._PROP + " SELECT 'posts' AS stage, count(*) AS n FROM posts UNION ALL SELECT 'batches', count(*) FROM post_batches UNION ALL SELECT 'comments', count(*) FROM comments UNION ALL SELECT 'candidates', count(*) FROM keyword_candidates UNION ALL SELECT 'topics', count(DISTINCT (community, key)) FROM tp",
}
