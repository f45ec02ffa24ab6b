"""Keywords mined from texts: n-grams, discovery with scores, library, promotion, selection.

Provenance (the ids behind a keyword) may be as long as the collection for a common one, so counts are distinct counts
that are combined on the map side, and the ids themselves come as a long table (``sources``), never as one row's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions import vocabulary as V


def searchable(norm: Column, words: V.Words = V.Words()) -> Column:
    """Whether a normalised phrase of two words or more is a keyword rather than a fragment."""
    inside = "|".join(dict.fromkeys([*words.noise, *words.fragments]))
    bad = rf"(?:^| )(?:{inside})(?: |$)|(?:^| )[0-9][0-9]+(?: |$)|^(?:{'|'.join(words.phrases)})$"
    return F.contains(norm, F.lit(" ")) & ~norm.rlike(bad) & norm.rlike(words.good()) & norm.rlike("[a-z]")


def with_terms(df: DataFrame, text: Column, into: str = "terms", words: V.Words = V.Words(), low: int = 2, high: int = 4) -> DataFrame:
    """``df`` with the distinct n-grams of a text that are keywords.

    Each token gets one letter (by hashed set lookups): N for one no keyword holds, s for a stop word, a for an anchor, b
    for both, o for others.  Whether a run of tokens is a keyword then shows in its few letters, and only those that are
    get joined.  Tokens and letters are columns of their own, as a lambda would work them out again for each run.
    Explode the result with ``explode_outer``: for ``explode`` the optimizer infers a filter on its size, which works the
    whole expression out once more at the scan.
    """
    df = df.withColumn("__tokens", T.keyword_tokens(text))
    tokens = F.col("__tokens")
    out = list(dict.fromkeys([*words.noise, *words.fragments]))
    both = [w for w in words.anchors if w in words.stop]
    letter = lambda t: F.when(t.isin(out) | t.rlike("^[0-9][0-9]+$"), "N").when(t.isin(both), "b").when(t.isin(list(words.stop)), "s").when(t.isin(list(words.anchors)), "a").otherwise("o")
    df = df.withColumn("__marks", F.array_join(F.transform(tokens, letter), ""))
    marks = F.col("__marks")
    good = "^(?:a[^N]*[ao]|o[^N]*a|o[^N]*[ab][^N]*[ao])$"
    n = F.size(tokens)

    def of(k: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.when(F.substring(marks, i, F.lit(k)).rlike(good), F.array_join(F.slice(tokens, i, F.lit(k)), " ")))
        return F.when(n >= k, F.array_compact(runs)).otherwise(F.array().cast("array<string>"))

    found = F.array_distinct(F.concat(*[of(k) for k in range(low, high + 1)]))
    found = F.array_except(found, F.array(*[F.lit(x) for x in words.phrases])) if words.phrases else found
    return df.withColumn(into, found).drop("__tokens", "__marks")


def mentions(df: DataFrame, words: V.Words = V.Words(), dictionary: list[str] = [], formal: list[str] = [], brands: list[str] = []) -> DataFrame:  # noqa: B006
    """term, method, record_id, post_id, author, community and signals: a row for each keyword and method of each record.

    ``df``: record_id, post_id, author, community, text.  Records without id or text give none.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    flags = {"pain": V.PAIN, "workaround": V.WORKAROUND, "purchase": V.PURCHASE, "promotional": V.PROMOTION}
    norm = F.col("norm")
    base = df.filter(F.col("record_id").isNotNull()).withColumn("norm", T.keyword_norm(F.col("text"))).select("record_id", "post_id", "author", "community", "text", "norm", *[low.rlike(p).cast("int").alias(k) for k, p in flags.items()], F.array_compact(F.array(*[F.when(T.contains_phrase(norm, f), F.lit(f)) for f in formal])).alias("parents") if formal else F.array().cast("array<string>").alias("parents"))
    base = with_terms(base, F.col("text"), "own", words)
    own = F.transform("own", lambda t: F.struct(t.alias("term"), F.lit("ngram").alias("method")))
    known = F.array_compact(F.array(*[F.when(T.contains_phrase(norm, d), F.struct(F.lit(d).alias("term"), F.lit("dictionary").alias("method"))) for d in dictionary])) if dictionary else None
    found = base.select("*", F.explode_outer(F.concat(own, known) if known is not None else own).alias("t")).filter("t IS NOT NULL").select(F.col("t.term").alias("term"), F.col("t.method").alias("method"), *[c for c in base.columns if c not in ("text", "own", "norm")])
    keep = (F.col("method") == "ngram") | searchable(F.col("term"), words)
    if formal:
        keep = keep & ~F.col("term").isin(list(formal))
    if brands:
        keep = keep & ~F.col("term").rlike(rf"(?:^| )(?:{'|'.join(brands)})(?: |$)")
    return found.filter(keep)


def discover(found: DataFrame) -> DataFrame:
    """Each keyword's counts, score parts and score from its mentions."""
    # A record may mention a term by two methods; its signals count once.
    each = found.groupBy("term", "record_id").agg(F.min("method").alias("first_method"), F.max("method").alias("last_method"), *[F.first(c).alias(c) for c in ("post_id", "author", "community", "pain", "workaround", "purchase", "promotional", "parents")])
    g = each.groupBy("term").agg(
        F.count("*").alias("n_evidence"), F.count_distinct("post_id").alias("n_posts"), F.count_distinct(T.blank_to_null(F.col("author"))).alias("n_authors"), F.count_distinct(T.blank_to_null(F.col("community"))).alias("n_communities"),
        *[F.sum(c).alias(c) for c in ("pain", "workaround", "purchase", "promotional")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("parents")))).alias("parents"),  # subsets of the fixed formal list
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("first_method", "last_method"))))).alias("methods"),  # of a fixed few
    )
    c = F.col
    words = F.size(F.split("term", " "))
    plus = F.least(c("n_authors"), F.lit(5)) * 8 + F.least(c("n_communities"), F.lit(3)) * 5 + F.when(words >= 2, 15).otherwise(6) + F.least(c("purchase") * 5, F.lit(15)) + F.least(c("pain") * 4 + c("workaround") * 2, F.lit(10)) + F.least(F.size("parents") * 5, F.lit(10)) + 10
    minus = F.when(c("n_authors") < 2, 10).otherwise(0) + F.when((c("n_posts") < 2) & (c("n_evidence") > 1), 6).otherwise(0) + F.least(c("promotional") * 5, F.lit(10)) + F.when(words == 1, 12).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), plus - minus)).cast("int")
    kind = F.when(c("term").rlike(r"\b(?:leak|seep|regen|fail|crack|clog)\b"), "pain").when(c("term").rlike(r"\b(?:ram|ford|silverado|sierra|f-?250|f-?350)\b"), "fitment").otherwise("product")
    return g.withColumn("score", score).withColumn("category", kind).withColumn("status", F.when(c("score") > 0, "candidate_review").otherwise("rejected"))


def sources(found: DataFrame) -> DataFrame:
    """term, kind, id: the distinct records, posts, authors and communities behind each keyword, as a long table."""
    ids = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, c in (("record", "record_id"), ("post", "post_id"), ("author", "author"), ("community", "community"))])
    return found.select("term", F.explode(ids).alias("x")).select("term", "x.kind", "x.id").filter(F.col("id").isNotNull() & (F.col("id") != "")).distinct()


def round_two(candidates: DataFrame, most: int | None = None, score: int = 65, users: int = 2, communities: int = 2) -> DataFrame:
    """The keywords that may start a second search, all of them or the best ``most``."""
    good = candidates.filter(~F.col("status").isin("formal", "rejected") & (F.col("score") >= score) & (F.col("n_authors") >= users) & (F.col("n_communities") >= communities)).orderBy(F.col("score").desc(), "term")
    return good if most is None else good.limit(most)


def library(posts: DataFrame, comments: DataFrame, formal: list[str] = [], words: V.Words = V.Words()) -> DataFrame:  # noqa: B006
    """Keyword table over posts (post_id, community, author, text) and comments (post_id, comment_id, author, text)."""
    none = F.lit(None).cast("string")
    rows = posts.select("post_id", none.alias("comment_id"), "author", "text", F.col("community"), F.lit("ngram").alias("method")).unionByName(comments.select("post_id", "comment_id", "author", "text", none.alias("community"), F.lit("comment").alias("method")))
    found = with_terms(rows, F.col("text"), "own", words).select("post_id", "comment_id", "author", "community", "method", F.explode_outer("own").alias("term")).filter("term IS NOT NULL")
    g = found.groupBy("term").agg(
        F.count_distinct("post_id").alias("n_posts"), F.count_distinct(T.blank_to_null(F.col("author"))).alias("n_authors"), F.count_distinct("comment_id").alias("n_comments"),
        F.array_sort(F.collect_set("method")).alias("methods"), F.min_by("community", F.when(F.col("community").isNotNull(), F.col("post_id"))).alias("community"),
    )
    score = F.least(F.lit(100), F.col("n_posts") * 12 + F.col("n_authors") * 8 + F.col("n_comments") * 2).cast("int")
    kind = (
        F.when(F.col("term").rlike(r"\b(?:leak|failure|failed|broken|crack|regen|clog|problem|issue)\b"), "pain").when(F.col("term").rlike(r"\b(?:kit|pipe|tuner|clamp|valve|cooler|downpipe|reroute)\b"), "product_or_solution").when(F.col("term").rlike(r"\b(?:towing|hauling|commute|winter|off road|work truck)\b"), "scenario").otherwise("phrase")
    )
    status = F.when(F.col("term").isin(list(formal)), "configured") if formal else F.when(F.lit(False), "configured")
    return g.select("*", F.concat(F.lit("kw_"), T.slug(F.col("term"), 48)).alias("keyword_id"), kind.alias("keyword_type"), score.alias("score")).withColumn("status", status.when(F.col("score") >= 20, "candidate_review").otherwise("weak_signal"))


def promoted(found: DataFrame, posts: int = 2, authors: int = 2) -> DataFrame:
    """term, display, n_posts, n_authors of model terms with enough posts and authors.  ``found``: ord, raw, post_id, author."""
    rows = found.withColumn("term", T.blank_to_null(T.keyword_norm(F.col("raw")))).filter("term IS NOT NULL")
    g = rows.groupBy("term").agg(F.count_distinct("post_id").alias("n_posts"), F.count_distinct("author").alias("n_authors"), F.min_by("raw", "ord").alias("display"))
    return g.filter((F.col("n_posts") >= posts) & (F.col("n_authors") >= authors))
