"""The pN_ queries of this subpackage over the tables of a data folder, and the SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import abuse, capping, frequency, history, mixing, names, pii, subjects, tokens, truncation
from tallyforge.session import exists, files_digest, mark, shared_dir, written
from tallyforge.sources.tables import table

CAP = 10
COMMON = 0.02
CUT = 0.5
ABUSIVE = 0.5


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    """All batches against the store of the posts, which is begun by the first call and opened again by later ones; accepted rows are appended to it."""
    posts, new = table(spark, folder, "posts"), table(spark, folder, "post_batches")
    path = f"{shared_dir(spark)}/tallyforge-history/{files_digest(posts)}"
    store = history.Store.open(spark, path)
    if not exists(spark, f"{path}/begun"):
        first = written(store.prints(posts, F.lit(0), F.lit(0), names.post_id(F.col("post_id")), "title"), "posts")
        store.append(first)
        mark(spark, f"{path}/begun")
    batch = written(store.prints(new, F.col("batch_no"), F.col("row_id"), names.post_id(F.col("post_id")), "title"), "batch")
    checked = store.check(batch)
    there = f"{path}/taken-{files_digest(new)}"
    if not exists(spark, there):
        store.append(checked.filter(~F.col("repeats")))  # later batches are held against these too
        mark(spark, there)
    store.close()
    return checked


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """row_id, post_id of every batch row that repeats an accepted post, with the accepted post's id."""
    return _checked(spark, folder).filter("repeats").select(F.col("r").alias("row_id"), F.col("match").alias("post_id"))


def p1_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, repeats and accepted rows of every batch."""
    return _checked(spark, folder).groupBy(F.col("b").alias("batch_no")).agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("repeats"), 1)).alias("n_repeats"), F.count(F.when(~F.col("repeats"), 1)).alias("n_accepted"))


def _cuts(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.scores(table(spark, folder, "comments"), "comment_id", "body", "source_surface")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """comment_id of every comment whose body was cut off."""
    return _cuts(spark, folder).filter(F.col("score") >= CUT).select("comment_id").distinct()


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries, cut ones and their share for every source surface."""
    cut = F.count(F.when(F.col("score") >= CUT, 1))
    return _cuts(spark, folder).groupBy("source_surface").agg(F.count("*").alias("n_rows"), cut.alias("n_cut"), (cut / F.count("*")).alias("share_cut"))


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    posts = table(spark, folder, "posts").select(F.lit("post").alias("record_kind"), F.col("post_id").alias("record_id"), F.col("subreddit").alias("group"), "body")
    comments = table(spark, folder, "comments").select(F.lit("comment").alias("record_kind"), F.col("comment_id").alias("record_id"), F.col("source_surface").alias("group"), "body")
    return posts.unionByName(comments)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """record_kind, record_id, pii_type of every kind of personal data in a body."""
    return pii.found(_bodies(spark, folder), ["record_kind", "record_id"], "body").distinct()


def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every body with typed placeholders for its personal data."""
    return pii.redacted(_bodies(spark, folder), ["record_kind", "record_id"], "body")


def p3_influence(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies, those with linked tokens, those whose labels the links change, and those whose messages had not settled."""
    return pii.influence(_bodies(spark, folder), "body")


def _abuse(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.scores(_bodies(spark, folder), ["record_kind", "record_id", "group"], "body")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """record_kind, record_id of every record whose body is abusive, hateful or sexually explicit."""
    return _abuse(spark, folder).filter(F.col("score") >= ABUSIVE).select("record_kind", "record_id").distinct()


def p7_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every body."""
    return _abuse(spark, folder).select("record_kind", "record_id", "score")


def p7_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Records, abusive ones and their share for every subreddit (posts) and source surface (comments)."""
    rows = _abuse(spark, folder)
    group = F.when(F.col("record_kind") == "post", F.regexp_replace(names.trimmed(F.lower("group")), "^/?r/", "")).otherwise(F.col("group"))
    hit = F.count(F.when(F.col("score") >= ABUSIVE, 1))
    return rows.groupBy("record_kind", group.alias("source")).agg(F.count("*").alias("n_records"), hit.alias("n_abusive"), (hit / F.count("*")).alias("share_abusive"))


def _contributions(spark: SparkSession, folder: str) -> DataFrame:
    posts = table(spark, folder, "posts").select(
        F.lit("post").alias("record_kind"), F.col("post_id").alias("record_id"), names.contributor(F.col("author")).alias("contributor"), F.col("score").cast("long").alias("by1"), F.col("comment_count").cast("long").alias("by2"), F.lit(None).cast("long").alias("by3")
    )
    words = table(spark, folder, "keyword_candidates").select("candidate_id", "discovery_score", F.explode(F.array_distinct(F.transform("authors", lambda a: names.contributor(a)))).alias("contributor"))
    words = words.select(
        F.lit("keyword").alias("record_kind"), F.col("candidate_id").cast("string").alias("record_id"), "contributor", F.col("discovery_score").cast("long").alias("by1"), F.lit(0).cast("long").alias("by2"), F.col("candidate_id").cast("long").alias("by3")
    )
    return posts.unionByName(words)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """record_kind, record_id, contributor of every record beyond a contributor's best ten of its kind."""
    rows = _contributions(spark, folder)
    key = F.when(F.col("contributor").isNotNull(), F.concat_ws("\x00", "contributor", "record_kind"))
    order = [F.col("by1").desc_nulls_last(), F.col("by2").desc_nulls_last(), F.col("by3").asc(), F.col("record_id").asc()]
    return capping.over_cap(rows, key, order, cap=CAP).select("record_kind", "record_id", "contributor")


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "keyword_candidates")
    return raw.select(names.term(F.col("normalized_term")).alias("term"), F.transform("source_post_ids", lambda x: names.post_id(x)).alias("ids"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """term, mark of the terms too rare or too common to be useful."""
    rows = _terms(spark, folder)
    counts = frequency.ngram_counts(rows, "term", "ids")
    total = rows.filter(F.col("term").isNotNull()).select(F.explode("ids").alias("id")).filter(F.col("id").isNotNull()).distinct().count()
    return frequency.marks(counts, total, COMMON)


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and distinct source posts of every term."""
    counts = frequency.ngram_counts(_terms(spark, folder), "term", "ids")
    return counts.filter(F.col("term_rows") > 0).select(F.col("ngram").alias("term"), F.col("term_rows").alias("n_rows"), F.col("term_records").alias("n_posts"))


def p5_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences, rows and distinct source posts of every n-gram within the terms."""
    return frequency.ngram_counts(_terms(spark, folder), "term", "ids", sigma=None).select("ngram", "occurrences", "n_rows", F.col("n_records").alias("n_posts"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids of every document by byte_bpe_50k."""
    return tokens.encoded(table(spark, folder, "documents"), "doc_id", "text")


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return tokens.token_counts(docs, "text")


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Every use of a document in the mixture: slot, doc_id, source, repeat_no, tokens."""
    return mixing.mixture(_sizes(spark, folder), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixing.shares(p9_mixture(spark, folder), table(spark, folder, "mix_targets"))


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    labelled = [(r.subject, r.text) for r in table(spark, folder, "subject_samples").select("subject", "text").collect() if r.subject and r.text]  # a fixed table
    known = {s for s, _ in labelled}
    lists = table(spark, folder, "communities").select("category", "include_terms").collect()  # a fixed table
    terms = [(r.category, t) for r in lists if r.category in known for t in r.include_terms or [] if t]
    return subjects.assigned(table(spark, folder, "documents"), "doc_id", "text", labelled, terms)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, subject of every subject a substantial part of a document is about."""
    return _subjects(spark, folder).select("doc_id", "subject").distinct()


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of every subject and their share of all documents."""
    n = table(spark, folder, "documents").count()
    return p10_found(spark, folder).groupBy("subject").agg(F.count("*").alias("n_documents"), (F.count("*") / F.lit(n)).alias("share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_batches, p2_found, p2_rates, p3_found, p3_redacted, p3_influence, p7_found, p7_scores, p7_rates, p4_found, p5_found, p5_terms, p5_ngrams, p8_ids, p9_mixture, p9_shares, p10_found, p10_shares)}

_P4 = """
WITH who AS (
  SELECT 'post' AS record_kind, post_id AS record_id, author AS raw, score AS by1, comment_count AS by2, 0 AS by3 FROM posts
  UNION ALL
  SELECT 'keyword', CAST(candidate_id AS VARCHAR), unnest(authors), discovery_score, 0, candidate_id FROM keyword_candidates),
named AS (SELECT DISTINCT record_kind, record_id, by1, by2, by3, regexp_replace(regexp_replace(lower(raw), '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g'), '^/?u/', '') AS contributor FROM who),
placed AS (SELECT record_kind, record_id, contributor, row_number() OVER (PARTITION BY record_kind, contributor ORDER BY by1 DESC NULLS LAST, by2 DESC NULLS LAST, by3, record_id) AS p
  FROM named WHERE contributor IS NOT NULL AND contributor NOT IN ('', '[deleted]'))
SELECT record_kind, record_id, contributor FROM placed WHERE p > 10
"""
_P5 = """
WITH canon AS (
  SELECT candidate_id, trim(nfc_normalize(regexp_replace(lower(nfc_normalize(normalized_term)), '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}_\\-\\x{2010}\\x{2011}]+', ' ', 'g'))) AS term, source_post_ids FROM keyword_candidates),
good AS (SELECT * FROM canon WHERE term <> ''),
links AS (SELECT term, 't3_' || regexp_replace(lower(trim(x)), '^t3_', '') AS id FROM (SELECT term, unnest(source_post_ids) AS x FROM good) WHERE trim(x) <> ''),
every AS (SELECT count(DISTINCT id) AS n FROM links),
per AS (SELECT g.term, count(DISTINCT g.candidate_id) AS n_rows, (SELECT count(DISTINCT id) FROM links l WHERE l.term = g.term) AS n_posts FROM good g GROUP BY g.term)
"""
ORACLE = {
    "p4_found": _P4,
    "p5_found": _P5 + "SELECT term, 'rare' AS mark FROM per WHERE n_posts = 1 UNION ALL SELECT term, 'common' FROM per, every WHERE n_posts > 0.02 * every.n",
    "p5_terms": _P5 + "SELECT term, n_rows, n_posts FROM per",
}
