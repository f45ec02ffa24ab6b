"""Topics: accepted proposals, counts, rates, trend, heat, metrics and the graph of communities and topics.

A topic's posts are kept as rows (community, key, post_id), so a topic with a third of all posts is no long list.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import text as T
from tallyforge.session import written

MOST_TOPICS = 3
CURRENT, BASELINE = 30, 60


def valid_evidence(refs: DataFrame, known: DataFrame) -> DataFrame:
    """prop_id, post_id, ok: whether a reference cites known evidence with a web address and says something in both languages.  ``refs``: prop_id, post_id, evidence_id, claim, translation; ``known``: post_id, evidence_id, url, one row each."""
    j = refs.join(known, ["post_id", "evidence_id"], "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    ok = F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)) & ~blank("claim") & ~blank("translation")
    return j.groupBy("prop_id", "post_id").agg(F.bool_and(ok).alias("ok"))


def accept(members: DataFrame, evidence: DataFrame, most: int = MOST_TOPICS) -> DataFrame:
    """community, prop_id, ord, decision ('accepted', 'no_eligible_posts', 'invalid_evidence'): proposals in order, each post in at most ``most`` accepted ones.

    ``members``: community, prop_id, ord, post_id (posts that exist); ``evidence``: prop_id, post_id, ok.  A proposal is
    accepted if some of its posts are still free and all its evidence is sound and about free posts.  Only sound proposals
    can take a place, so a post that fewer than ``most`` of them name before is surely free.  What depends on posts named
    more often is decided by one pass in order over each community, which holds a number for each such post; so there are
    as many jobs however long the chains of proposals are.  Proposals without any post are not in ``members``: the caller
    adds them as 'no_eligible_posts'.
    """
    one = ["community", "ord", "prop_id"]
    m = members.select(*one, "post_id").distinct()
    cited = evidence.groupBy("prop_id", "post_id").agg(F.bool_and("ok").alias("ok"))
    refs = cited.groupBy("prop_id").agg(F.bool_and("ok").alias("all_ok"), F.count("*").alias("n_refs"))
    x = m.join(cited.select("prop_id", "post_id", F.lit(True).alias("cited")), ["prop_id", "post_id"], "left").withColumn("n_in", F.count("cited").over(Window.partitionBy(*one)))
    sound = F.coalesce(F.col("all_ok"), F.lit(False)) & (F.col("n_in") == F.coalesce("n_refs", F.lit(0)))  # none is about a post outside
    x = x.filter("prop_id IS NOT NULL").join(refs, "prop_id", "left").select(*one, "post_id", F.col("cited").isNotNull().alias("cited"), sound.alias("sound"))
    before = Window.partitionBy("community", "post_id").orderBy("ord", "prop_id").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("doubtful", F.count(F.when(F.col("sound"), 1)).over(before) >= most).withColumn("contested", F.max("doubtful").over(Window.partitionBy("community", "post_id")))
    x = written(x.withColumn("sure", ~F.min("doubtful").over(Window.partitionBy(*one))).drop("doubtful"), "proposals")
    open_ = x.filter(F.col("contested") & (F.col("sound") | ~F.col("sure"))).withColumn("slot", F.dense_rank().over(Window.partitionBy("community").orderBy("post_id")) - 1)
    kinds = dict(x.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in one) + ", decided string"
    decided = open_.select(*one, "slot", "sound", "cited", "sure").sortWithinPartitions(*one).mapInArrow(_fold(most), schema)
    each = x.groupBy(*one).agg(F.bool_and("sound").alias("sound"))
    return each.join(decided, one, "left").select("community", "prop_id", "ord", F.coalesce("decided", F.when(F.col("sound"), "accepted").otherwise("invalid_evidence")).alias("decision"))


def _fold(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Decisions on the rows (community, ord, prop_id, slot, sound, cited, sure) of a partition, in order; communities lie in one partition each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, at, key = array("i"), None, None
        free, bad, some, sound = [], False, False, False

        def decision() -> str:
            if not free and not some:
                return "no_eligible_posts"
            if bad or not sound:
                return "invalid_evidence"
            for s in free:
                used[s] += 1
            return "accepted"

        for b in batches:
            out: list[tuple] = []
            for c, o, p, slot, is_sound, cited, sure in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (c, o, p) != key:
                    if key is not None:
                        out.append((*key, decision()))
                    if c != at:
                        used, at = array("i"), c
                    key, free, bad, some, sound = (c, o, p), [], False, sure, is_sound
                if slot >= len(used):
                    used.extend([0] * (slot + 1 - len(used)))
                if used[slot] < most:
                    free.append(slot)
                else:
                    bad |= cited
            yield _decisions(out, b.schema)
        if key is not None:
            yield _decisions([(*key, decision())], b.schema)

    return run


def _decisions(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
    types = [*like.types[:3], pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[*like.names[:3], "decided"])


def counts(topic_posts: DataFrame, posts: DataFrame, comments: DataFrame, commenters: DataFrame, as_of: datetime) -> DataFrame:
    """Counts, rates, status and trend of each topic.  ``posts``: post_id, author, score, created_at; ``comments``: post_id, comment_id; ``commenters``: post_id, name."""
    n_comments = comments.groupBy("post_id").agg(F.count_distinct("comment_id").alias("n_comments"))
    p = topic_posts.select("community", "key", "post_id").distinct().join(posts.select("post_id", "author", "score", "created_at"), "post_id").join(n_comments, "post_id", "left")
    t = F.lit(as_of)
    since = lambda d: t - F.expr(f"INTERVAL {d} DAYS")
    now = (F.col("created_at") >= since(CURRENT)) & (F.col("created_at") <= t)
    then = (F.col("created_at") >= since(CURRENT + BASELINE)) & (F.col("created_at") < since(CURRENT))
    g = p.groupBy("community", "key").agg(
        F.count("*").alias("n_posts"), F.count_distinct(T.blank_to_null(F.col("author"))).alias("n_authors"), F.sum(F.greatest(F.coalesce("score", F.lit(0)), F.lit(0))).alias("upvotes"),
        F.sum(F.coalesce("n_comments", F.lit(0))).alias("n_comments"), F.count(F.when(now, 1)).alias("n_current"), F.count(F.when(then, 1)).alias("n_baseline"),
    )
    tp = topic_posts.select("community", "key", "post_id").distinct()
    people = tp.join(commenters, "post_id").select("community", "key", "name", F.lit(True).alias("c")).unionByName(p.filter(F.trim(F.coalesce("author", F.lit(""))) != "").select("community", "key", F.lower("author").alias("name"), F.lit(False).alias("c")))
    each = people.groupBy("community", "key", "name").agg(F.bool_or("c").alias("c"))
    who = each.groupBy("community", "key").agg(F.count(F.when(F.col("c"), 1)).alias("n_commenters"), F.count("*").alias("n_participants"))
    x = g.join(who, ["community", "key"], "left").fillna(0, ["n_commenters", "n_participants"])
    formal = ((F.col("n_posts") >= 3) & (F.col("n_authors") >= 3)) | ((F.col("n_posts") >= 2) & (F.col("n_commenters") >= 10))
    x = x.withColumn("status", F.when(formal, "formal").otherwise("weak_signal"))
    # Rates as fractions of whole numbers: current / 30 against baseline / 60, so that comparisons are exact.
    cur, base = F.col("n_current") * 2, F.col("n_baseline")
    trend = F.when((F.col("status") == "formal") & (cur > 0) & (base == 0), "new").when(base == 0, "stable").when((cur - base) * 2 >= base, "rising").when((cur - base) * 4 < -base, "falling").otherwise("stable")
    return x.withColumn("trend", trend).withColumn("topic_id", T.topic_id(F.col("community"), F.col("key")))


def heat(counted: DataFrame) -> DataFrame:
    """With ``heat``: 0 to 100 in hundredths, each part relative to the community's largest."""
    rate = lambda c, d: F.round(F.col(c) / F.lit(float(d)), 4)
    parts = {
        "n_posts": (0.30, F.col("n_posts").cast("double")), "n_authors": (0.20, F.col("n_authors").cast("double")), "n_commenters": (0.20, F.col("n_commenters").cast("double")),
        "upvotes": (0.15, F.log1p(F.col("upvotes").cast("double"))), "growth": (0.15, rate("n_current", CURRENT) / F.greatest(rate("n_baseline", BASELINE), F.lit(1 / BASELINE))),
    }
    top = counted.groupBy("community").agg(*[F.max(v).alias(f"max_{k}") for k, (_, v) in parts.items()])
    x = counted.join(top, "community")
    score = sum((F.lit(w) * F.when(F.col(f"max_{k}") > 0, v / F.col(f"max_{k}")).otherwise(0.0) for k, (w, v) in parts.items()), F.lit(0.0))
    return x.withColumn("heat", F.round(score * 100, 2)).select(*counted.columns, "heat")


def signal(hot: DataFrame, confidence: str, n_evidence: str) -> DataFrame:
    """With ``signal`` (0 to 10, one decimal) and ``priority`` of looking into a topic."""
    s = F.round(F.col("heat") / 100 * 4 + F.col(confidence) * 3 + F.least(F.lit(1.0), F.col(n_evidence) / F.lit(12.0)) * 2 + F.when(F.col("status") == "formal", 1.0).otherwise(0.3), 1)
    x = hot.withColumn("signal", F.least(F.greatest(s, F.lit(0.0)), F.lit(10.0)))
    return x.withColumn("priority", F.when((F.col("status") == "formal") & (F.col("signal") >= 7), "priority_validate").when(F.col("status") == "formal", "validate").when(F.col("signal") >= 3, "observe").otherwise("skip"))


def metrics(posts: DataFrame, comments: DataFrame, commenters: DataFrame, topics: DataFrame, topic_posts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct counts over everything (community 'all') and for each community.

    Each count is one aggregation over (community, thing) pairs with a rollup on top of the pairs; deleted names are nobody.
    """
    name = lambda c: F.when(~F.lower(F.trim(c)).isin("[deleted]", "deleted", "none", ""), F.lower(F.trim(c)))
    where = posts.select("post_id", "community")
    things = [
        ("n_posts", posts.select("community", F.col("post_id").alias("x"))),
        ("n_post_authors", posts.select("community", name(F.col("author")).alias("x"))),
        ("n_commenters", commenters.join(where, "post_id").select("community", name(F.col("name")).alias("x"))),
        ("n_participants", posts.select("community", name(F.col("author")).alias("x")).unionByName(commenters.join(where, "post_id").select("community", name(F.col("name")).alias("x")))),
        ("n_comments", comments.join(where, "post_id").select("community", F.col("comment_id").alias("x"))),
        ("n_topics", topics.select("community", F.concat_ws("|", "community", "key").alias("x"))),
        ("n_formal_topics", topics.filter("status = 'formal'").select("community", F.concat_ws("|", "community", "key").alias("x"))),
        ("n_topic_posts", topic_posts.select("community", F.col("post_id").alias("x"))),
        ("n_evidence", evidence.select("community", F.concat_ws("|", "post_id", "evidence_id", "url").alias("x"))),
    ]
    pairs = None
    for k, df in things:
        d = df.filter("x IS NOT NULL AND community IS NOT NULL").select(F.lit(k).alias("metric"), "community", "x").distinct()
        pairs = d if pairs is None else pairs.unionByName(d)
    each = pairs.groupBy("metric", "community").agg(F.count("*").alias("n"))
    everything = pairs.groupBy("metric").agg(F.count_distinct("x").alias("n")).select("metric", F.lit("all").alias("community"), "n")
    return each.unionByName(everything)


def graph(topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label) and edges (source, target) of communities and their formal topics."""
    t = topics.filter((F.col("status") == "formal") & (F.trim("community") != "") & (F.trim("topic_id") != ""))
    com = F.concat(F.lit("community:"), F.col("community"))
    nodes = t.select(com.alias("id"), F.lit("community").alias("type"), F.col("community").alias("label")).distinct().unionByName(t.select(F.col("topic_id").alias("id"), F.lit("topic").alias("type"), F.col("key").alias("label")))
    return nodes, t.select(com.alias("source"), F.col("topic_id").alias("target"))
