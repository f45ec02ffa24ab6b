"""Queries of the rule cascade and of keyword mining over posts and comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions import vocabulary as V
from tallyforge.operators import gate as G
from tallyforge.operators import keywords as K
from tallyforge.plans.listing_queries import _WS, _collapse
from tallyforge.sources.tables import table

#: The lexicon of these queries, in the tables' own words.
LEXICON = V.Lexicon(
    platforms=("korvan", "varga nord", "mistrune", "ostrelle"),
    products=("turbo actuator", "oil pan", "boost hose", "fuel filter housing", "exhaust brake", "lift pump", "soot filter", "head gasket"),
    vehicle_terms=("packhorse", "carrier 9", "atlas 7", "range pro"),
    scenarios=("towing uphill", "freezing rain"),
    brands=("korvan", "mistrune"),
    slang=("limp mode",),
    off_domain=("bench press", "zoning permit"),
    excluded_communities=("slowkitchen", "pitchside"),
    promotional=("discount",),
    approved_communities=("rigwrench", "haulers", "vanlifefix", "towtalk"),
)
FORMAL = ["oil pan", "lift pump", "fuel filter housing"]
DICTIONARY = ["turbo actuator", "oil pan kit", "exhaust brake", "soot filter"]


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Posts and comments (one row a comment id) as records in a fixed order."""
    p = table(spark, folder, "posts").select(F.lit("post").alias("record_type"), F.col("post_id").alias("ord"), F.col("post_id").alias("record_id"), "post_id", F.coalesce("author", F.lit("")).alias("author"), T.community_key(F.col("subreddit")).alias("community"), "title", "body", F.col("score"))
    c = table(spark, folder, "comments").groupBy("comment_id").agg(*[F.min(x).alias(x) for x in ("post_id", "author", "body")])
    where = table(spark, folder, "posts").select("post_id", T.community_key(F.col("subreddit")).alias("community"))
    c = c.join(where, "post_id", "left").select(F.lit("comment").alias("record_type"), F.col("comment_id").alias("ord"), F.col("comment_id").alias("record_id"), "post_id", F.coalesce("author", F.lit("")).alias("author"), "community", F.lit(None).cast("string").alias("title"), "body", F.lit(0).cast("long").alias("score"))
    return p.unionByName(c)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).select("record_type", "record_id", "post_id", "author", "community", F.concat_ws(" ", "title", "body").alias("text"))


def q_gate_flags(spark, folder):
    x = G.flags(records(spark, folder), LEXICON)
    names = [*G.FLAGS, "product_hit", "platform_hit", "vehicle_hit", "approved"]
    return x.groupBy("record_type", F.coalesce("hard", F.lit("")).alias("hard")).agg(F.count("*").alias("n"), *[F.count(F.when(F.col(k), 1)).alias(k) for k in names])


def q_gate_duplicates(spark, folder):
    x = G.reasons(G.flags(records(spark, folder), LEXICON))
    return x.filter("reason = 'duplicate'").select("record_type", "record_id", F.col("first_ord").alias("first_id"))


def q_gate_score(spark, folder):
    x = G.scored(G.reasons(G.flags(records(spark, folder), LEXICON)))
    return x.select("record_type", "record_id", "role", "claim_status", "band", F.col("quality").cast("long").alias("quality"), F.coalesce("reason", F.lit("")).alias("reason"), (F.col("weight") * 100).cast("long").alias("weight100"))


def q_gate_distribution(spark, folder):
    return G.distribution(G.scored(G.reasons(G.flags(records(spark, folder), LEXICON))))


def q_gate_relevant(spark, folder):
    x = G.flags(records(spark, folder), LEXICON).filter("record_type = 'post'")
    return x.groupBy("community").agg(F.count("*").alias("n"), F.count(F.when(G.relevant(x), 1)).alias("n_relevant"))


def q_ngrams(spark, folder):
    t = K.with_terms(table(spark, folder, "posts"), F.col("title")).select("post_id", F.explode_outer("terms").alias("term")).filter("term IS NOT NULL")
    return t.groupBy("term").agg(F.count("*").alias("n"))


def _found(spark, folder):
    return K.mentions(texts(spark, folder), dictionary=DICTIONARY, formal=FORMAL, brands=["korvan", "mistrune"])


def q_keyword_candidates(spark, folder):
    c = K.discover(_found(spark, folder))
    return c.select("term", "n_evidence", "n_posts", "n_authors", "n_communities", F.array_join("methods", ",").alias("methods"), F.array_join("parents", ",").alias("parents"), F.col("score").cast("long").alias("score"), "category", "status")


def q_keyword_sources(spark, folder):
    return K.sources(_found(spark, folder)).groupBy("term", "kind").agg(F.count("*").alias("n"))


def q_round_two(spark, folder):
    return K.round_two(K.discover(_found(spark, folder)), score=60).select("term", F.col("score").cast("long").alias("score"))


def q_keyword_library(spark, folder):
    x = texts(spark, folder)
    lib = K.library(x.filter("record_type = 'post'").select("post_id", "community", "author", "text"), x.filter("record_type = 'comment'").select("post_id", F.col("record_id").alias("comment_id"), "author", "text"), FORMAL)
    return lib.select("term", "keyword_id", "keyword_type", "n_posts", "n_authors", "n_comments", F.array_join("methods", ",").alias("methods"), F.coalesce("community", F.lit("")).alias("community"), F.col("score").cast("long").alias("score"), "status")


def q_promoted_terms(spark, folder):
    k = table(spark, folder, "keyword_candidates").withColumn("post", F.explode("source_post_ids")).withColumn("who", F.explode("authors"))
    rows = k.select(F.col("candidate_id").alias("ord"), F.col("term").alias("raw"), T.post_id(F.col("post")).alias("post_id"), F.lower("who").alias("author"))
    return K.promoted(rows)


def q_searchable(spark, folder):
    norm = T.keyword_norm(F.col("normalized_term"))
    k = table(spark, folder, "keyword_candidates").select(norm.alias("term"), F.coalesce(K.searchable(norm), F.lit(False)).alias("searchable"))
    return k.groupBy("term", "searchable").agg(F.count("*").alias("n"))


def q_active_keywords(spark, folder):
    """Terms of active statuses that are keywords, in the order in which they first came."""
    norm = T.keyword_norm(F.col("normalized_term"))
    k = table(spark, folder, "keyword_candidates").filter(F.lower("status").isin("seed", "configured", "formal", "active")).withColumn("t", norm)
    return k.filter(K.searchable(F.col("t"))).groupBy(F.col("t").alias("term")).agg(F.min("candidate_id").alias("first_id"))


def q_suggestions(spark, folder):
    """Review queue of each run: its candidates but the configured and rejected ones, numbered over all rows of the run."""
    from pyspark.sql.window import Window

    k = table(spark, folder, "keyword_candidates").withColumn("index", F.row_number().over(Window.partitionBy("run_id").orderBy("candidate_id")))
    keep = ~F.lower("status").isin("configured", "approved", "rejected") & (F.trim(F.coalesce("normalized_term", F.lit(""))) != "")
    return k.filter(keep).select(F.concat_ws(":", F.lit("suggestion"), "run_id", F.col("index").cast("string")).alias("suggestion_id"), "candidate_id")


def q_clip(spark, folder):
    """Clipped projections for prompts."""
    return table(spark, folder, "posts").select("post_id", T.clip(F.col("title"), 60).alias("title"), T.clip(F.col("body"), 120).alias("body"), F.length(T.clip(F.col("body"), 1200)).alias("chars"))


QUERIES = {f.__name__: f for f in (q_gate_flags, q_gate_duplicates, q_gate_score, q_gate_distribution, q_gate_relevant, q_ngrams, q_keyword_candidates, q_keyword_sources, q_round_two, q_keyword_library, q_promoted_terms, q_searchable, q_active_keywords, q_suggestions, q_clip)}


def _any(terms) -> str:
    return r"\b(?:" + "|".join(terms) + r")\b"


RECORDS_SQL = f"""
place AS (SELECT post_id, nullif(regexp_replace({_collapse('lower(subreddit)')}, '^/?r/', ''), '') AS community FROM posts),
said AS (SELECT comment_id, min(post_id) AS post_id, min(author) AS author, min(body) AS body FROM comments GROUP BY 1),
records AS (
  SELECT 'post' AS record_type, post_id AS record_id, post_id, coalesce(author, '') AS author, community, title, body, score FROM posts JOIN place USING (post_id)
  UNION ALL SELECT 'comment', comment_id, post_id, coalesce(author, ''), community, NULL, body, 0 FROM said LEFT JOIN place USING (post_id))"""
_L = LEXICON
FLAGS_SQL = (
    RECORDS_SQL
    + f""", x0 AS (SELECT *, concat_ws(chr(10), CASE WHEN trim(coalesce(title, '')) <> '' THEN trim(title) END, CASE WHEN trim(coalesce(body, '')) <> '' THEN trim(body) END) AS text FROM records),
x1 AS (SELECT *, lower(text) AS lower_, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://[^\\s\\x{{0b}}]+', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM x0),
x2 AS (SELECT *, {', '.join(f"regexp_matches(lower_, '{p}') AS {k}" for k, p in G.FLAGS.items())},
  regexp_matches(lower_, '{_any(_L.products)}') AS product_hit, regexp_matches(lower_, '{_any(_L.platforms)}') AS platform_hit, regexp_matches(lower_, '{_any(_L.vehicle_terms)}') AS vehicle_hit,
  coalesce(lower(community), '') IN ({', '.join(f"'{c}'" for c in _L.approved_communities)}) AS approved,
  CASE WHEN lower(author) = 'automoderator' OR regexp_matches(lower(author), '(?:^|[_-])bot(?:$|[_-])') THEN 'bot_author'
    WHEN regexp_matches(text, '(?i)^\\s*\\[(?:deleted|removed)\\]\\s*$') THEN 'deleted_or_removed' WHEN regexp_matches(trim(text), '(?i)^https?://\\S+$') THEN 'url_only'
    WHEN regexp_matches(lower_, '{_any((*_L.promotional, *G.PROMOTION))}') THEN 'promotion' WHEN regexp_matches(text, '(?i)^\\s*(?:same|this|lol|lmao|nice|agreed|following|bump)\\s*[.!?]*\\s*$') THEN 'banter'
    WHEN regexp_matches(lower_, '{_any(_L.off_domain)}') OR coalesce(lower(community), '') IN ({', '.join(f"'{c}'" for c in _L.excluded_communities)}) THEN 'off_domain' END AS hard FROM x1),
x3 AS (SELECT *, approved OR platform_hit OR vehicle_hit AS in_domain, hard IS NULL AND (approved OR platform_hit OR vehicle_hit) AS registers FROM x2)"""
)
REASONS_SQL = (
    FLAGS_SQL
    + """, firsts AS (SELECT record_type, norm, min(record_id) AS first_id FROM x3 WHERE registers AND norm <> '' GROUP BY 1, 2),
x4 AS (SELECT x3.*, first_id, CASE WHEN hard IS NOT NULL THEN hard WHEN x3.norm <> '' AND first_id < record_id THEN 'duplicate' WHEN NOT in_domain THEN 'missing_context' END AS reason FROM x3 LEFT JOIN firsts USING (record_type, norm)),
x5 AS (SELECT *, CASE WHEN first_person THEN 20 WHEN practitioner AND diagnostic THEN 15 ELSE 0 END + CASE WHEN product_hit OR market THEN 15 ELSE 0 END + CASE WHEN context OR vehicle OR platform_hit OR vehicle_hit OR approved THEN 15 ELSE 0 END
  + CASE WHEN outcome THEN 20 ELSE 0 END + CASE WHEN purchase THEN 10 ELSE 0 END + CASE WHEN diagnostic THEN 10 ELSE 0 END + least(5, floor(ln(1 + greatest(coalesce(score, 0), 0))))::INT
  - CASE WHEN (CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END) < 8 THEN 5 ELSE 0 END - CASE WHEN regexp_matches(lower_, '"""
    + G.ADVERT
    + """') THEN 10 ELSE 0 END - CASE WHEN regexp_matches(ltrim(text), '^["'']') AND NOT first_person THEN 5 ELSE 0 END AS total FROM x4),
x6 AS (SELECT *, CASE WHEN reason IS NULL THEN greatest(0, least(100, total)) ELSE 0 END AS quality,
  CASE WHEN reason IS NOT NULL THEN 'noise' WHEN first_person AND (outcome OR completed) AND (product_hit OR platform_hit) THEN 'direct_experience' WHEN practitioner AND diagnostic AND (product_hit OR platform_hit) THEN 'qualified_practitioner'
    WHEN demand AND (context OR vehicle OR product_hit OR platform_hit) THEN 'contextual_demand' WHEN product_hit OR platform_hit OR (approved AND (outcome OR demand OR market)) THEN 'market_observation' ELSE 'weak' END AS role FROM x5)"""
)
_NG = "list_distinct(flatten([[array_to_string(list_slice(w, i, i + n - 1), ' ') for i in range(1, len(w) - n + 2)] for n in [2, 3, 4]]))"
_GOOD, _BAD = V.Words().good(), V.Words().bad()
_INSIDE = "|".join(dict.fromkeys([*V.NOISE, *V.FRAGMENTS]))
_SEARCH_BAD = rf"(?:^| )(?:{_INSIDE})(?: |$)|(?:^| )[0-9][0-9]+(?: |$)|^(?:{'|'.join(V.PHRASES)})$"


def _search(t: str) -> str:
    return f"({t} LIKE '% %' AND NOT regexp_matches({t}, '{_SEARCH_BAD}') AND regexp_matches({t}, '{_GOOD}') AND regexp_matches({t}, '[a-z]'))"


def _terms(x: str) -> str:
    return f"(SELECT unnest({_NG}) AS term FROM (SELECT regexp_extract_all(lower({x}), '[a-z0-9]+') AS w))"


_TEXTS = RECORDS_SQL + ", t AS (SELECT record_type, record_id, post_id, author, community, concat_ws(' ', title, body) AS text FROM records), w AS (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM t)"
_HAS = lambda f: f"(' ' || array_to_string(w, ' ') || ' ') LIKE '% {f} %'"
FOUND_SQL = (
    _TEXTS
    + f""", b AS (SELECT *, {', '.join(f"regexp_matches(lower(text), '{p}')::INT AS {k}" for k, p in (('pain', V.PAIN), ('workaround', V.WORKAROUND), ('purchase', V.PURCHASE), ('promotional', V.PROMOTION)))},
  list_filter([{', '.join(f"CASE WHEN {_HAS(f)} THEN '{f}' END" for f in FORMAL)}], lambda z: z IS NOT NULL) AS parents FROM w),
raw_m AS (SELECT *, 'ngram' AS method FROM (SELECT * EXCLUDE (w, text), unnest(list_filter({_NG}, lambda g: regexp_matches(g, '{_GOOD}') AND NOT regexp_matches(g, '{_BAD}') AND regexp_matches(g, '[a-z]'))) AS term FROM b)
  UNION ALL BY NAME SELECT *, 'dictionary' AS method FROM (SELECT * EXCLUDE (w, text), unnest(list_filter([{', '.join(f"CASE WHEN {_HAS(f)} THEN '{f}' END" for f in DICTIONARY)}], lambda z: z IS NOT NULL)) AS term FROM b)),
m AS (SELECT * FROM raw_m WHERE {_search('term')} AND term NOT IN ({', '.join(f"'{f}'" for f in FORMAL)}) AND NOT regexp_matches(term, '(?:^| )(?:korvan|mistrune)(?: |$)'))"""
)
CAND_SQL = (
    FOUND_SQL
    + """, e AS (SELECT term, record_id, list(DISTINCT method) AS ms, any_value(post_id) AS post_id, any_value(author) AS author, any_value(community) AS community, any_value(pain) AS pain, any_value(workaround) AS workaround, any_value(purchase) AS purchase, any_value(promotional) AS promotional, any_value(parents) AS parents FROM m GROUP BY 1, 2),
g AS (SELECT term, count(*) AS n_evidence, count(DISTINCT post_id) AS n_posts, count(DISTINCT nullif(author, '')) AS n_authors, count(DISTINCT nullif(community, '')) AS n_communities, sum(pain) AS pain, sum(workaround) AS workaround, sum(purchase) AS purchase, sum(promotional) AS promotional,
  list_sort(list_distinct(flatten(list(parents)))) AS parents, list_sort(list_distinct(flatten(list(ms)))) AS methods FROM e GROUP BY 1),
c AS (SELECT *, greatest(0, least(100, least(n_authors, 5) * 8 + least(n_communities, 3) * 5 + CASE WHEN term LIKE '% %' THEN 15 ELSE 6 END + least(purchase * 5, 15) + least(pain * 4 + workaround * 2, 10) + least(len(parents) * 5, 10) + 10
  - CASE WHEN n_authors < 2 THEN 10 ELSE 0 END - CASE WHEN n_posts < 2 AND n_evidence > 1 THEN 6 ELSE 0 END - least(promotional * 5, 10) - CASE WHEN term LIKE '% %' THEN 0 ELSE 12 END))::BIGINT AS score FROM g),
cand AS (SELECT *, CASE WHEN regexp_matches(term, '\\b(?:leak|seep|regen|fail|crack|clog)\\b') THEN 'pain' WHEN regexp_matches(term, '\\b(?:ram|ford|silverado|sierra|f-?250|f-?350)\\b') THEN 'fitment' ELSE 'product' END AS category, CASE WHEN score > 0 THEN 'candidate_review' ELSE 'rejected' END AS status FROM c)"""
)
_FLAG_NAMES = [*G.FLAGS, "product_hit", "platform_hit", "vehicle_hit", "approved"]
_NORMK = "array_to_string(regexp_extract_all(lower(coalesce(normalized_term, '')), '[a-z0-9]+'), ' ')"
ORACLE = {
    "q_gate_flags": "WITH " + FLAGS_SQL + f" SELECT record_type, coalesce(hard, '') AS hard, count(*) AS n, {', '.join(f'count(*) FILTER ({k}) AS {k}' for k in _FLAG_NAMES)} FROM x3 GROUP BY 1, 2",
    "q_gate_duplicates": "WITH " + REASONS_SQL + " SELECT record_type, record_id, first_id FROM x4 WHERE reason = 'duplicate'",
    "q_gate_score": "WITH " + REASONS_SQL + """ SELECT record_type, record_id, role, CASE WHEN role IN ('direct_experience', 'qualified_practitioner') THEN 'fact' WHEN role IN ('contextual_demand', 'market_observation') THEN 'inference' ELSE 'unknown' END AS claim_status,
CASE WHEN quality >= 70 THEN 'high' WHEN quality >= 50 THEN 'medium' WHEN quality >= 30 THEN 'weak' ELSE 'noise' END AS band, quality::BIGINT AS quality, coalesce(reason, '') AS reason,
CASE WHEN role NOT IN ('weak', 'noise') AND quality >= 50 THEN CASE WHEN role = 'contextual_demand' THEN 65 ELSE 100 END ELSE 0 END::BIGINT AS weight100 FROM x6""",
    "q_gate_distribution": "WITH " + REASONS_SQL + ", n AS (SELECT record_type, role, count(*) AS n FROM x6 GROUP BY 1, 2) SELECT k.record_type, r.role, coalesce(n, 0) AS n FROM (SELECT DISTINCT record_type FROM n) k CROSS JOIN (SELECT unnest([" + ", ".join(f"'{r}'" for r in G.ROLES) + "]) AS role) r LEFT JOIN n ON n.record_type = k.record_type AND n.role = r.role",
    "q_gate_relevant": "WITH " + FLAGS_SQL + " SELECT community, count(*) AS n, count(*) FILTER (registers) AS n_relevant FROM x3 WHERE record_type = 'post' GROUP BY 1",
    "q_ngrams": f"WITH w AS (SELECT post_id, regexp_extract_all(lower(title), '[a-z0-9]+') AS w FROM posts), t AS (SELECT unnest(list_filter({_NG}, lambda g: regexp_matches(g, '{_GOOD}') AND NOT regexp_matches(g, '{_BAD}') AND regexp_matches(g, '[a-z]'))) AS term FROM w) SELECT term, count(*) AS n FROM t GROUP BY 1",
    "q_keyword_candidates": "WITH " + CAND_SQL + " SELECT term, n_evidence, n_posts, n_authors, n_communities, array_to_string(methods, ',') AS methods, array_to_string(parents, ',') AS parents, score, category, status FROM cand",
    "q_keyword_sources": "WITH " + FOUND_SQL + ", s AS (SELECT DISTINCT term, 'record' AS kind, record_id AS id FROM m UNION SELECT term, 'post', post_id FROM m UNION SELECT term, 'author', author FROM m UNION SELECT term, 'community', community FROM m) SELECT term, kind, count(*) AS n FROM s WHERE id <> '' GROUP BY 1, 2",
    "q_round_two": "WITH " + CAND_SQL + " SELECT term, score FROM cand WHERE score >= 60 AND n_authors >= 2 AND n_communities >= 2",
    "q_keyword_library": "WITH " + _TEXTS + f""", f AS (SELECT CASE WHEN record_type = 'comment' THEN record_id END AS comment_id, post_id, author, CASE WHEN record_type = 'post' THEN community END AS community, CASE WHEN record_type = 'post' THEN 'ngram' ELSE 'comment' END AS method,
unnest(list_filter({_NG}, lambda g: regexp_matches(g, '{_GOOD}') AND NOT regexp_matches(g, '{_BAD}') AND regexp_matches(g, '[a-z]'))) AS term FROM w),
g AS (SELECT term, count(DISTINCT post_id) AS n_posts, count(DISTINCT nullif(author, '')) AS n_authors, count(DISTINCT comment_id) AS n_comments, list_sort(list(DISTINCT method)) AS methods, arg_min(community, post_id) FILTER (community IS NOT NULL) AS community FROM f WHERE {_search('term')} GROUP BY 1),
s AS (SELECT *, least(100, n_posts * 12 + n_authors * 8 + n_comments * 2) AS score FROM g)
SELECT term, 'kw_' || substr(trim(regexp_replace(term, '[^a-z0-9]+', '_', 'g'), '_'), 1, 48) AS keyword_id, CASE WHEN regexp_matches(term, '\\b(?:leak|failure|failed|broken|crack|regen|clog|problem|issue)\\b') THEN 'pain' WHEN regexp_matches(term, '\\b(?:kit|pipe|tuner|clamp|valve|cooler|downpipe|reroute)\\b') THEN 'product_or_solution' WHEN regexp_matches(term, '\\b(?:towing|hauling|commute|winter|off road|work truck)\\b') THEN 'scenario' ELSE 'phrase' END AS keyword_type,
n_posts, n_authors, n_comments, array_to_string(methods, ',') AS methods, coalesce(community, '') AS community, score, CASE WHEN term IN ({', '.join(f"'{f}'" for f in FORMAL)}) THEN 'configured' WHEN score >= 20 THEN 'candidate_review' ELSE 'weak_signal' END AS status FROM s""",
    "q_promoted_terms": f"WITH a AS (SELECT candidate_id AS ord, term AS raw, unnest(source_post_ids) AS post, authors FROM keyword_candidates), b AS (SELECT ord, raw, post, unnest(authors) AS who FROM a), c AS (SELECT ord, raw, CASE WHEN regexp_replace({_collapse('lower(post)')}, '^t3_', '') <> '' THEN 't3_' || regexp_replace({_collapse('lower(post)')}, '^t3_', '') END AS post_id, lower(who) AS author, array_to_string(regexp_extract_all(lower(coalesce(raw, '')), '[a-z0-9]+'), ' ') AS term FROM b) SELECT term, count(DISTINCT post_id) AS n_posts, count(DISTINCT author) AS n_authors, arg_min(raw, ord) AS display FROM c WHERE term <> '' GROUP BY 1 HAVING count(DISTINCT post_id) >= 2 AND count(DISTINCT author) >= 2",
    "q_searchable": f"SELECT term, {_search('term')} AS searchable, count(*) AS n FROM (SELECT {_NORMK} AS term FROM keyword_candidates) GROUP BY 1, 2",
    "q_active_keywords": f"SELECT term, min(candidate_id) AS first_id FROM (SELECT {_NORMK} AS term, candidate_id, status FROM keyword_candidates) WHERE lower(status) IN ('seed', 'configured', 'formal', 'active') AND {_search('term')} GROUP BY 1",
    "q_suggestions": "WITH k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY candidate_id) AS i FROM keyword_candidates) SELECT concat_ws(':', 'suggestion', run_id, i::VARCHAR) AS suggestion_id, candidate_id FROM k WHERE lower(status) NOT IN ('configured', 'approved', 'rejected') AND trim(coalesce(normalized_term, '')) <> ''",
    "q_clip": f"SELECT post_id, substr(trim(regexp_replace(coalesce(title, ''), '{_WS}+', ' ', 'g')), 1, 60) AS title, substr(trim(regexp_replace(coalesce(body, ''), '{_WS}+', ' ', 'g')), 1, 120) AS body, length(substr(trim(regexp_replace(coalesce(body, ''), '{_WS}+', ' ', 'g')), 1, 1200)) AS chars FROM posts",
}
