"""Repeated expansion: terms find posts, posts give new terms, until nothing new comes."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import written


def expand(first_terms: DataFrame, posts_of: Callable[[DataFrame], DataFrame], terms_of: Callable[[DataFrame], DataFrame], rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(term, round) and (post_id, round): everything reached and when.

    ``posts_of`` takes new terms and gives post_id; ``terms_of`` takes new posts and gives term.  Each round is written,
    so plans don't grow, and holds only what is new: a term is searched once, in lower case, a post is read once.  With
    ``rounds`` it stops after so many; without, when a round brings nothing new.
    """
    low = F.lower(F.trim("term")).alias("term")
    fresh = written(first_terms.select(low).filter("term <> ''").distinct().withColumn("round", F.lit(0)), "terms")
    terms, posts = fresh, None
    for n in itertools.count(1) if rounds is None else range(1, rounds + 1):
        found = posts_of(fresh.select("term")).select("post_id").distinct()
        if posts is not None:
            found = found.join(posts.select("post_id"), "post_id", "left_anti")
        found = written(found.withColumn("round", F.lit(n)), "posts")
        if found.isEmpty():
            break
        posts = found if posts is None else posts.unionByName(found)
        fresh = written(terms_of(found.select("post_id")).select(low).filter("term <> ''").distinct().join(terms.select("term"), "term", "left_anti").withColumn("round", F.lit(n)), "terms")
        if fresh.isEmpty():
            break
        terms = terms.unionByName(fresh)
    return terms, posts if posts is not None else terms.select(F.lit(None).cast("string").alias("post_id"), "round").limit(0)
