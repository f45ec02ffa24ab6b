"""How often every term and every n-gram of terms occurs, in how many rows and records.

Suffix-sorted counting: each term is a list of tokens, every suffix of it is routed by its first token, sorted in descending order, and one pass with a stack counts all prefixes at
once: a prefix's set of records is complete when it is popped, and passes into its parent's.  With ``sigma`` every suffix
but the first is cut to so many tokens: enough for counts of whole terms, but longer n-grams count only at a term's start.

A first token may hold a third of all rows, and its record sets may be as large as the collection.  So a route is the
first token together with a bucket of the record's hash: the sets of two buckets have no record in common, their
sizes add up exactly, and one aggregation that is combined on the map side adds them.  The number of buckets grows
with the number of records (``per_route``), which bounds a route's sets whatever the skew.

Defined cases: null and blank terms and record ids don't count; repeated ids count once; a term whose records are all
null or blank has 0 of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 4
PER_ROUTE = 200_000
_OUT = "ngram string, occurrences long, n_rows long, n_records long, term_rows long, term_records long"


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []
    stack: list[str] = []
    held: list[list] = []  # for each level: occurrences, rows, records, whole term's rows, whole term's records
    route = None

    def shrink(to: int) -> None:
        while len(stack) > to:
            occurrences, rows, records, term_rows, term_records = held.pop()
            out.append((" ".join(stack), occurrences, len(rows), len(records), len(term_rows), len(term_records)))
            stack.pop()
            if held:
                up = held[-1]
                up[0] += occurrences
                for k, s in ((1, rows), (2, records)):
                    if len(s) > len(up[k]):
                        up[k], s = s, up[k]
                    up[k] |= s

    for f in frames:
        for first, bucket, suffix, is_row, rec, whole in zip(f["first"], f["bucket"], f["suffix"], f["is_row"], f["rec"], f["whole"], strict=True):
            if (first, bucket) != route:
                shrink(0)
                route = (first, bucket)
            same = 0
            for a, b in zip(stack, suffix):
                if a != b:
                    break
                same += 1
            shrink(same)
            for t in suffix[same:]:
                stack.append(t)
                held.append([0, set(), set(), set(), set()])
            top = held[-1]
            if is_row:
                top[0] += 1
            top[1 if is_row else 2].add(rec)
            if whole:
                top[3 if is_row else 4].add(rec)
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _OUT.split(", ")])
            out.clear()
    shrink(0)
    if out:
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _OUT.split(", ")])


def ngram_counts(df: DataFrame, term: str, records: str, sigma: int | None = SIGMA, per_route: int = PER_ROUTE) -> DataFrame:
    """ngram, occurrences, n_rows, n_records, and term_rows, term_records: the same of the rows whose whole term it is.

    ``term`` is a column in its canonical form (tokens split by single spaces), ``records`` an array of canonical ids.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(term).isNotNull()).select(F.split(term, " ").alias("tokens"), F.array_distinct(F.filter(records, lambda x: x.isNotNull())).alias("ids"), F.monotonically_increasing_id().cast("string").alias("row"))
    total = rows.agg(F.sum(1 + F.coalesce(F.size("ids"), F.lit(0))).alias("n")).first()["n"] or 0
    buckets = max(8, -(-total // per_route))
    entries = F.array_append(F.transform(F.coalesce("ids", F.array().cast("array<string>")), lambda x: F.struct(F.lit(False).alias("is_row"), x.alias("rec"))), F.struct(F.lit(True).alias("is_row"), F.col("row").alias("rec")))
    each = rows.select("tokens", F.explode(entries).alias("e")).select("tokens", "e.*")
    n = F.size("tokens")
    suffixes = each.select("is_row", "rec", F.pmod(F.xxhash64("rec"), F.lit(buckets)).alias("bucket"), F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.when(i == 1, F.col("tokens")).otherwise(F.slice("tokens", i, n if sigma is None else F.lit(sigma))).alias("suffix"), (i == 1).alias("whole")))).alias("s"))
    routed = suffixes.select(F.col("s.suffix")[0].alias("first"), "bucket", "s.suffix", "is_row", "rec", "s.whole")
    sorted_ = routed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "first", "bucket").sortWithinPartitions("first", "bucket", F.col("suffix").desc())
    parts = sorted_.mapInPandas(_count, _OUT)
    return parts.groupBy("ngram").agg(*[F.sum(c).alias(c) for c in ("occurrences", "n_rows", "n_records", "term_rows", "term_records")])


def marks(counts: DataFrame, total: int, common_share: float) -> DataFrame:
    """term, mark: 'rare' with exactly one record, 'common' with more than ``common_share`` of all records."""
    mark = F.array_compact(F.array(F.when(F.col("term_records") == 1, F.lit("rare")), F.when(F.col("term_records") * 1_000_000 > round(common_share * 1_000_000) * total, F.lit("common"))))  # in whole numbers: a share of exactly the limit is not above it
    return counts.filter(F.col("term_rows") > 0).select(F.col("ngram").alias("term"), F.explode(mark).alias("mark"))
