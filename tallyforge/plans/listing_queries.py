"""Queries over listing rows: posts and newly collected batches."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import listing as L
from tallyforge.sources.tables import table

HOST = "https://forum.example"
AS_OF = datetime(2026, 6, 15)
START, END = date(2026, 1, 1), date(2026, 6, 15)
K = 20


def normal(spark: SparkSession, folder: str) -> DataFrame:
    """History and batches as one normalised listing."""
    return L.normalize(table(spark, folder, "posts").unionByName(table(spark, folder, "post_batches"), allowMissingColumns=True), HOST)


def good(spark: SparkSession, folder: str) -> DataFrame:
    return L.accepted(normal(spark, folder))


def windowed(spark: SparkSession, folder: str) -> DataFrame:
    """De-duplicated posts of the last 90 days with their window and priority."""
    x = L.dedup(good(spark, folder)).withColumn("window", L.window_label(F.col("created_at"), AS_OF)).filter(F.col("window").isNotNull())
    return x.withColumn("priority", L.priority(F.col("window"), F.col("score"), F.col("comment_count"))).withColumn("community", T.community_key(F.col("subreddit")))


def _micros(c: str):
    return F.unix_micros(c).alias(c)


def q_normalize(spark, folder):
    return L.normalize(table(spark, folder, "post_batches"), HOST).select("row_id", "post_id", "url", "subreddit", "title", "author", _micros("created_at"), "score", "comment_count", F.coalesce("reject", F.lit("")).alias("reject"))


def q_quarantine(spark, folder):
    return normal(spark, folder).groupBy(F.coalesce("reject", F.lit("accepted")).alias("reject")).agg(F.count("*").alias("n"))


def q_canonical_url(spark, folder):
    return table(spark, folder, "comments").select(T.canonical_url(F.col("url"), HOST).alias("url")).groupBy("url").agg(F.count("*").alias("n"))


def q_surface_fanout(spark, folder):
    return L.fan_out(table(spark, folder, "posts"), "listing").groupBy("surface").agg(F.count("*").alias("n"), F.countDistinct("post_id").alias("n_posts"))


def q_dedup_two_phase(spark, folder):
    d = L.dedup(good(spark, folder))
    return d.select("post_id", "url", "title", F.coalesce("author", F.lit("")).alias("author"), _micros("created_at"), "score", "comment_count", F.array_join("source_surfaces", ",").alias("surfaces"))


def q_merge_surfaces(spark, folder):
    rows = L.fan_out(good(spark, folder).filter(F.col("row_id").isNotNull()), "listing").withColumn("ord", F.col("row_id") * 100 + F.array_position("source_surfaces", F.col("surface")))
    m = L.merge_first_wins(rows, "post_id", "ord", ["title", "url"], "body", ["score", "comment_count"], "surface")
    return m.select("post_id", "title", "url", F.length("body").alias("body_chars"), "score", "comment_count", F.array_join("surface", ",").alias("surfaces"))


def q_merge_search(spark, folder):
    inside = F.unix_timestamp("created_at").between(F.unix_timestamp(F.lit(START).cast("timestamp")), F.unix_timestamp(F.lit(END).cast("timestamp")) + 86399)
    rows = good(spark, folder).filter(F.col("row_id").isNotNull() & inside).withColumn("query", F.concat(F.lit("q"), (F.col("row_id") % 7).cast("string")))
    m = L.merge_first_wins(rows, "post_id", "row_id", ["title"], "body", ["score", "comment_count"], "query")
    return m.select("post_id", "title", "score", "comment_count", F.array_join("query", ",").alias("queries"))


def q_window_label(spark, folder):
    w = F.coalesce(L.window_label(F.col("created_at"), AS_OF), F.lit("dropped"))
    return L.dedup(good(spark, folder)).groupBy(w.alias("window")).agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def q_window_scope(spark, folder):
    w = F.coalesce(L.window_scope(F.col("created_at"), START, END), F.lit("dropped"))
    return L.dedup(good(spark, folder)).groupBy(w.alias("window")).agg(F.count("*").alias("n"), F.sum("comment_count").alias("comment_count"))


def q_priority(spark, folder):
    return windowed(spark, folder).select("post_id", "window", "priority")


def q_shortlist_topk(spark, folder):
    return L.top_k(windowed(spark, folder), K).select("community", "rank", "post_id", "priority")


def q_month_round_robin(spark, folder):
    x = L.dedup(good(spark, folder)).withColumn("community", T.community_key(F.col("subreddit"))).withColumn("priority", L.priority(F.lit("baseline"), F.col("score"), F.col("comment_count")))
    return L.month_round_robin(x, K).select("community", "turn", "post_id", "month")


def q_shortlist_stratified(spark, folder):
    return L.stratified(windowed(spark, folder), K).select("community", "pick", "post_id", "stage")


def q_balanced_range(spark, folder):
    return L.balanced(windowed(spark, folder), K).select("community", "place", "post_id")


def q_deep_read_cap(spark, folder):
    x = windowed(spark, folder)
    read = x.join(table(spark, folder, "comments").select("post_id").distinct(), "post_id", "left_semi").filter("window = 'current'")
    return L.read_targets(x, read, 60).select("community", "post_id", "n")


def q_coverage(spark, folder):
    x = good(spark, folder).withColumn("community", T.community_key(F.col("subreddit"))).filter(F.to_date("created_at").between(F.lit(START), F.lit(END)))
    hint = F.when(F.col("batch_no") == 3, "partial").when(F.col("batch_no") == 5, "complete")
    return L.coverage(x, ["community"], START, hint).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


def q_keyword_coverage(spark, folder):
    x = table(spark, folder, "keyword_candidates").withColumn("term", T.blank_to_null(T.keyword_norm(F.col("normalized_term")))).filter("term IS NOT NULL").withColumn("created_at", F.col("found_at"))
    return L.coverage(x, ["term"], START, F.when(F.col("status") == "weak_signal", "partial")).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


def q_run_coverage(spark, folder):
    return L.run_status(q_coverage(spark, folder))


def q_round_two_merge(spark, folder):
    """Posts already there are kept, new ones of the batches appended (first delivery of each id)."""
    old = L.accepted(L.normalize(table(spark, folder, "posts"), HOST)).select("post_id", F.lit("history").alias("origin"))
    new = L.accepted(L.normalize(table(spark, folder, "post_batches"), HOST)).groupBy("post_id").agg(F.min("batch_no").alias("b"))
    new = new.join(old.select("post_id"), "post_id", "left_anti").select("post_id", F.concat(F.lit("batch_"), F.col("b").cast("string")).alias("origin"))
    return old.unionByName(new)


QUERIES = {f.__name__: f for f in (q_normalize, q_quarantine, q_canonical_url, q_surface_fanout, q_dedup_two_phase, q_merge_surfaces, q_merge_search, q_window_label, q_window_scope, q_priority, q_shortlist_topk, q_month_round_robin, q_shortlist_stratified, q_balanced_range, q_deep_read_cap, q_coverage, q_keyword_coverage, q_run_coverage, q_round_two_merge)}

_WS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x{0b}]"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _url(x: str) -> str:
    a = f"CASE WHEN regexp_matches({_collapse(x)}, '(?i)^https?://') THEN {_collapse(x)} WHEN {_collapse(x)} LIKE '/%' THEN '{HOST}' || {_collapse(x)} ELSE '{HOST}/' || {_collapse(x)} END"
    return f"CASE WHEN {_collapse(x)} <> '' THEN 'https://' || lower(regexp_extract({a}, '(?i)^https?://([^/?#]*)', 1)) || regexp_replace(regexp_extract({a}, '(?i)^https?://[^/?#]*([^?#]*)', 1), '/+$', '') END"


NORMAL_SQL = f"""
raw AS (
  SELECT NULL::BIGINT AS row_id, NULL::INT AS batch_no, post_id, url, subreddit, title, body, author, created_at, score, comment_count, source_surfaces FROM posts
  UNION ALL BY NAME SELECT row_id, batch_no, post_id, url, subreddit, title, body, author, created_at, score, comment_count, source_surfaces FROM post_batches),
normal AS (
  SELECT row_id, batch_no,
    CASE WHEN regexp_replace({_collapse('lower(post_id)')}, '^t3_', '') <> '' THEN 't3_' || regexp_replace({_collapse('lower(post_id)')}, '^t3_', '') END AS post_id,
    {_url('url')} AS url,
    nullif(regexp_replace({_collapse('subreddit')}, '^/?[rR]/', ''), '') AS subreddit,
    nullif({_collapse('title')}, '') AS title, coalesce(trim(body), '') AS body, nullif({_collapse('author')}, '') AS author, created_at,
    greatest(coalesce(score, 0), 0)::BIGINT AS score, greatest(coalesce(comment_count, 0), 0)::BIGINT AS comment_count, coalesce(source_surfaces, []) AS source_surfaces
  FROM raw),
judged AS (SELECT *, CASE WHEN post_id IS NULL THEN 'missing_id' WHEN url IS NULL THEN 'missing_url' WHEN subreddit IS NULL THEN 'missing_subreddit' WHEN title IS NULL THEN 'missing_title' WHEN created_at IS NULL THEN 'missing_time' END AS reject FROM normal),
good AS (SELECT * FROM judged WHERE reject IS NULL)"""
_KEY = "struct_pack(a := length(body), b := body, c := score, d := comment_count, e := url, f := post_id, g := title, h := coalesce(author, ''), i := created_at, j := subreddit)"


def _merge_sql(source: str, key: str) -> str:
    return f"""SELECT r.body AS body, r.url AS url, r.post_id AS post_id, r.title AS title, r.author AS author, r.created_at AS created_at, r.subreddit AS subreddit, score, comment_count, source_surfaces FROM (
  SELECT {key} AS k, arg_max(struct_pack(body, url, post_id, title, author, created_at, subreddit), {_KEY}) AS r, max(score) AS score, max(comment_count) AS comment_count, list_sort(list_distinct(flatten(list(source_surfaces)))) AS source_surfaces FROM {source} GROUP BY 1)"""


DEDUP_SQL = NORMAL_SQL + f", phase1 AS ({_merge_sql('good', 'post_id')}), posts_d AS ({_merge_sql('phase1', 'url')})"
_LABEL = "CASE WHEN created_at > TIMESTAMP '2026-06-15' THEN NULL WHEN created_at >= TIMESTAMP '2026-06-15' - INTERVAL 30 DAY THEN 'current' WHEN created_at >= TIMESTAMP '2026-06-15' - INTERVAL 90 DAY THEN 'baseline' END"
_SCOPE = "CASE WHEN created_at::DATE BETWEEN DATE '2026-01-01' AND DATE '2026-06-15' THEN CASE WHEN date_diff('day', created_at::DATE, DATE '2026-06-15') <= 30 THEN 'current' ELSE 'baseline' END END"
_COMMUNITY = f"nullif(regexp_replace({_collapse('lower(subreddit)')}, '^/?r/', ''), '')"
WINDOWED_SQL = DEDUP_SQL + f""", labelled AS (SELECT *, {_LABEL} AS w FROM posts_d),
x AS (SELECT *, CASE WHEN w = 'current' THEN 6000 ELSE 0 END + least(score, 100) * 30 + least(comment_count, 100) * 10 AS priority, {_COMMUNITY} AS community FROM labelled WHERE w IS NOT NULL)"""
_RANK = "priority DESC, score DESC, comment_count DESC, post_id"
_SPEC = r"\b(?:fail(?:ed|ure)?|broken|leak|fitment|install|replace|repair|towing|haul|price|cost|which|help|problem|issue)\b"


def _strat_sql() -> str:
    sql = WINDOWED_SQL + f""", s0 AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY {_RANK}) AS rk, strftime(created_at, '%Y-%m') AS month,
  len(regexp_extract_all(lower(title || ' ' || body), '{_SPEC}')) AS spec, list_contains(source_surfaces, 'controversial') AS disputed FROM x),
s1 AS (SELECT *, row_number() OVER (PARTITION BY community, month ORDER BY rk) AS im FROM s0),
p0 AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY im, month DESC) AS turn, row_number() OVER (PARTITION BY community ORDER BY spec DESC, rk) AS words, NULL::BIGINT AS pick, NULL::INT AS stage, 0::BIGINT AS taken FROM s1)"""
    quotas = [max(1, round(K * 0.10)), max(1, round(K * 0.25)), max(1, round(K * 0.15)), round(K * 0.50), K]
    for i, (q, order) in enumerate(zip(quotas, ["rk", "turn", "words", "rk", "rk"], strict=True)):
        ok = "pick IS NULL" + (" AND disputed" if i == 0 else "")
        sql += f""", n{i} AS (SELECT * EXCLUDE (pick, stage), pick AS old, stage AS olds, CASE WHEN {ok} THEN row_number() OVER (PARTITION BY community, ({ok}) ORDER BY {order}) END AS nx FROM p{i}),
m{i} AS (SELECT * EXCLUDE (old, olds, nx), coalesce(old, CASE WHEN nx <= least({q}, {K} - taken) THEN taken + nx END) AS pick, CASE WHEN old IS NOT NULL THEN olds WHEN nx <= least({q}, {K} - taken) THEN {i + 1} END AS stage FROM n{i}),
p{i + 1} AS (SELECT * EXCLUDE (taken), count(pick) OVER (PARTITION BY community) AS taken FROM m{i})"""
    return "WITH " + sql + " SELECT community, pick, post_id, stage FROM p5 WHERE pick IS NOT NULL"


def _balanced_sql() -> str:
    q = max(1, int(K * 0.7) - 1)
    return "WITH " + WINDOWED_SQL + f""", a AS (SELECT *, list_contains(source_surfaces, 'new') AS isnew, row_number() OVER (PARTITION BY community ORDER BY created_at DESC, post_id) AS ap FROM x),
b AS (SELECT *, CASE WHEN isnew THEN row_number() OVER (PARTITION BY community, isnew ORDER BY created_at DESC, post_id) END AS np FROM a),
c AS (SELECT *, max(np) OVER (PARTITION BY community) AS nl FROM b),
d AS (SELECT *, CASE WHEN np <= {q} THEN 1 WHEN np = nl THEN 2 END AS s FROM c),
e AS (SELECT *, CASE WHEN s IS NULL THEN CASE WHEN len(list_filter(source_surfaces, lambda z: z LIKE 'top%')) > 0 THEN 0 WHEN list_contains(source_surfaces, 'controversial') THEN 1 WHEN list_contains(source_surfaces, 'hot') THEN 2 END END AS kind FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY community, kind ORDER BY created_at DESC, post_id) AS kp FROM e),
g AS (SELECT *, CASE WHEN s = 1 THEN 1 WHEN s = 2 THEN 2 WHEN kind IS NOT NULL THEN 3 ELSE 4 END AS k1, CASE WHEN s = 1 THEN np WHEN s = 2 THEN 0 WHEN kind IS NOT NULL THEN kp ELSE ap END AS k2, CASE WHEN s IS NULL AND kind IS NOT NULL THEN kind ELSE 0 END AS k3 FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY k1, k2, k3, post_id) AS place FROM g)
SELECT community, place, post_id FROM h WHERE place <= {K}"""


_COVER = "min(created_at)::DATE::VARCHAR AS first_day, max(created_at)::DATE::VARCHAR AS last_day, count(*) AS n_rows, CASE WHEN bool_or(hint = 'partial') THEN 'partial' WHEN bool_or(hint = 'complete') THEN 'complete' WHEN min(created_at)::DATE <= DATE '2026-01-01' THEN 'complete' ELSE 'partial' END AS status"
_COVERAGE = "WITH " + NORMAL_SQL + f", c AS (SELECT {_COMMUNITY} AS community, created_at, CASE batch_no WHEN 3 THEN 'partial' WHEN 5 THEN 'complete' END AS hint FROM good WHERE created_at::DATE BETWEEN DATE '2026-01-01' AND DATE '2026-06-15'), cover AS (SELECT community, {_COVER} FROM c GROUP BY 1) "
_FIRST = "arg_min({0}, ord) AS {0}"
ORACLE = {
    "q_normalize": "WITH " + NORMAL_SQL + " SELECT row_id, post_id, url, subreddit, title, author, epoch_us(created_at) AS created_at, score, comment_count, coalesce(reject, '') AS reject FROM judged WHERE row_id IS NOT NULL",
    "q_quarantine": "WITH " + NORMAL_SQL + " SELECT coalesce(reject, 'accepted') AS reject, count(*) AS n FROM judged GROUP BY 1",
    "q_canonical_url": f"SELECT {_url('url')} AS url, count(*) AS n FROM comments GROUP BY 1",
    "q_surface_fanout": "WITH o AS (SELECT post_id, list_filter(coalesce(source_surfaces, []), lambda s: trim(s) <> '') AS own FROM posts) SELECT surface, count(*) AS n, count(DISTINCT post_id) AS n_posts FROM (SELECT post_id, unnest(CASE WHEN len(own) > 0 THEN own ELSE ['listing'] END) AS surface FROM o) GROUP BY 1",
    "q_dedup_two_phase": "WITH " + DEDUP_SQL + " SELECT post_id, url, title, coalesce(author, '') AS author, epoch_us(created_at) AS created_at, score, comment_count, array_to_string(source_surfaces, ',') AS surfaces FROM posts_d",
    "q_merge_surfaces": "WITH " + NORMAL_SQL + """, o AS (SELECT *, list_filter(source_surfaces, lambda s: trim(s) <> '') AS own FROM good WHERE row_id IS NOT NULL), f AS (SELECT *, unnest(CASE WHEN len(own) > 0 THEN own ELSE ['listing'] END) AS surface FROM o),
g AS (SELECT *, row_id * 100 + list_position(source_surfaces, surface) AS ord FROM f), firsts AS (SELECT post_id, surface, min(ord) AS fst FROM g GROUP BY 1, 2), lists AS (SELECT post_id, string_agg(surface, ',' ORDER BY fst) AS surfaces FROM firsts GROUP BY 1)
SELECT g.post_id, arg_min(title, ord) AS title, arg_min(url, ord) AS url, max(length(body)) AS body_chars, max(score) AS score, max(comment_count) AS comment_count, any_value(surfaces) AS surfaces FROM g JOIN lists USING (post_id) GROUP BY 1""",
    "q_merge_search": "WITH " + NORMAL_SQL + """, g AS (SELECT *, 'q' || (row_id % 7)::VARCHAR AS query FROM good WHERE row_id IS NOT NULL AND created_at::DATE BETWEEN DATE '2026-01-01' AND DATE '2026-06-15'),
firsts AS (SELECT post_id, query, min(row_id) AS fst FROM g GROUP BY 1, 2), lists AS (SELECT post_id, string_agg(query, ',' ORDER BY fst) AS queries FROM firsts GROUP BY 1)
SELECT g.post_id, arg_min(title, row_id) AS title, max(score) AS score, max(comment_count) AS comment_count, any_value(queries) AS queries FROM g JOIN lists USING (post_id) GROUP BY 1""",
    "q_window_label": "WITH " + DEDUP_SQL + f' SELECT coalesce({_LABEL}, \'dropped\') AS "window", count(*) AS n, sum(score)::BIGINT AS score FROM posts_d GROUP BY 1',
    "q_window_scope": "WITH " + DEDUP_SQL + f' SELECT coalesce({_SCOPE}, \'dropped\') AS "window", count(*) AS n, sum(comment_count)::BIGINT AS comment_count FROM posts_d GROUP BY 1',
    "q_priority": "WITH " + WINDOWED_SQL + ' SELECT post_id, w AS "window", priority FROM x',
    "q_shortlist_topk": "WITH " + WINDOWED_SQL + f" SELECT community, row_number() OVER (PARTITION BY community ORDER BY {_RANK}) AS rank, post_id, priority FROM x QUALIFY rank <= {K}",
    "q_month_round_robin": "WITH " + DEDUP_SQL + f""", x AS (SELECT *, least(score, 100) * 30 + least(comment_count, 100) * 10 AS priority, {_COMMUNITY} AS community, strftime(created_at, '%Y-%m') AS month FROM posts_d),
y AS (SELECT *, row_number() OVER (PARTITION BY community, month ORDER BY {_RANK}) AS im FROM x) SELECT community, row_number() OVER (PARTITION BY community ORDER BY im, month DESC) AS turn, post_id, month FROM y QUALIFY turn <= {K}""",
    "q_shortlist_stratified": _strat_sql(),
    "q_balanced_range": _balanced_sql(),
    "q_deep_read_cap": "WITH " + WINDOWED_SQL + f""", done AS (SELECT community, post_id FROM x WHERE w = 'current' AND post_id IN (SELECT post_id FROM comments)), have AS (SELECT community, count(*) AS have FROM done GROUP BY 1),
t AS (SELECT x.community, post_id, row_number() OVER (PARTITION BY x.community ORDER BY {_RANK}) AS n, coalesce(have, 0) AS have FROM x LEFT JOIN have USING (community) WHERE post_id NOT IN (SELECT post_id FROM done)) SELECT community, post_id, n FROM t WHERE n + have <= 60""",
    "q_coverage": _COVERAGE + "SELECT * FROM cover",
    "q_keyword_coverage": f"WITH k AS (SELECT array_to_string(regexp_extract_all(lower(normalized_term), '[a-z0-9]+'), ' ') AS term, found_at AS created_at, CASE WHEN status = 'weak_signal' THEN 'partial' END AS hint FROM keyword_candidates) SELECT term, {_COVER} FROM k WHERE term <> '' GROUP BY 1",
    "q_run_coverage": _COVERAGE + "SELECT CASE WHEN count(*) > 0 AND bool_and(status = 'complete') THEN 'completed' ELSE 'partial' END AS status FROM cover",
    "q_round_two_merge": "WITH " + NORMAL_SQL + ", old AS (SELECT post_id FROM good WHERE row_id IS NULL), new AS (SELECT post_id, min(batch_no) AS b FROM good WHERE row_id IS NOT NULL GROUP BY 1) SELECT post_id, 'history' AS origin FROM old UNION ALL SELECT post_id, 'batch_' || b::VARCHAR FROM new WHERE post_id NOT IN (SELECT post_id FROM old)",
}
