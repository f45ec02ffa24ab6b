"""A mixture of sources in target shares of tokens.

Every source's documents are shuffled by a hash and cut into blocks of equal tokens (a document belongs to the block
in which it starts, so any run of blocks has the wanted number of tokens to within one document).  A slot of the
mixture holds one block; slot k belongs to the source in whose interval of the cumulative shares the golden-ratio
point k * phi mod 1 falls, which keeps every source's share right in every stretch of the schedule.  The slots of a
source, ranked, walk through its blocks again and again, at most ``max_repeats`` times.

Size of the mixture: the largest in which every source that has documents reaches its share within its repeats, or
``total_tokens``, where sources that are too small for it end early and the shares reached show it.

Defined cases: targets without documents get no slot, and the other shares are scaled to sum 1; documents whose source
has no target, and documents without tokens, are not used; null sources match nothing; with no documents or no target
the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.session import shared_dir, written

GOLDEN = 0.6180339887498949
CHUNK = 65_536
#: Tokens of a block: a 64th of the smallest source, within these bounds.
LEAST, MOST, PARTS = 64, 65_536, 64
_MIX = "slot long, doc_id long, source string, repeat_no int, tokens long"


def blocks(sizes: DataFrame, seed: int) -> tuple[DataFrame, dict[str, int]]:
    """doc_id, source, tokens, start: the tokens of the source before the document in shuffled order; and the tokens of each source."""
    spark = sizes.sparkSession
    shared_dir(spark)
    keys = [F.col("source").asc(), F.col("h").asc(), F.col("doc_id").asc()]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = sizes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("h").checkpoint()
    pid = F.spark_partition_id().alias("pid")
    base: dict[tuple[int, str], int] = {}
    total: dict[str, int] = {}
    # One row for each partition and source that meet: at most partitions + sources, as the rows are sorted by source.
    for r in sorted(kept.select(pid, "source", "tokens").groupBy("pid", "source").agg(F.sum("tokens").alias("n")).collect()):
        base[r.pid, r.source] = total.get(r.source, 0)
        total[r.source] = base[r.pid, r.source] + r.n

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict[str, int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            d = b.column(2).dictionary_encode()
            code, names = d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()
            tokens = b.column(3).to_numpy(zero_copy_only=False)
            start = np.zeros(b.num_rows, np.int64)
            p = b.column(0)[0].as_py()
            for k, name in enumerate(names):
                own = np.flatnonzero(code == k)
                ends = np.cumsum(tokens[own]) + so_far.get(name, base[p, name])
                start[own] = ends - tokens[own]
                so_far[name] = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(start)], names=["doc_id", "source", "tokens", "start"])

    return kept.select(pid, "doc_id", "source", "tokens").mapInArrow(place, "doc_id long, source string, tokens long, start long"), total


def schedule(spark, slots: int, weights: dict[str, float]) -> DataFrame:
    """slot, source, rank: the slots 0 … slots-1 by golden-ratio points, ranked within their source."""
    u = F.pmod(F.col("id") * F.lit(GOLDEN) + F.lit(0.5), F.lit(1.0))
    edge, source = 0.0, F.lit(None).cast("string")
    names = list(weights)
    edges = []
    for name in names:
        edge += weights[name]
        edges.append((name, edge))
    source = F.when(u < edges[0][1], F.lit(edges[0][0]))
    for name, e in edges[1:-1]:
        source = source.when(u < e, F.lit(name))
    source = source.otherwise(F.lit(edges[-1][0]))
    points = spark.range(slots).select(F.col("id").alias("slot"), source.alias("source"), F.expr(f"id div {CHUNK}").alias("chunk"))
    each = points.groupBy("chunk", "source").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row for each 65,536 slots
    offsets = each.select("chunk", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("chunk", "source").orderBy("slot")
    return points.withColumn("k", F.row_number().over(inside)).join(offsets, ["chunk", "source"]).select("slot", "source", (F.col("before") + F.col("k") - 1).alias("rank"))


def mixture(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """slot, doc_id, source, repeat_no, tokens of every use of a document.  ``sizes``: doc_id, source, tokens; ``targets``: source, target_share, max_repeats, one row a source (collected)."""
    spark = sizes.sparkSession
    want = {r.source: (r.target_share, r.max_repeats) for r in targets.collect() if r.source is not None and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0}
    used = sizes.filter(F.col("source").isin(*want) & (F.col("tokens") > 0)).select("doc_id", "source", "tokens")
    placed, total = blocks(used, seed)
    there = {s: want[s] for s in sorted(total)}
    if not there:
        return spark.createDataFrame([], _MIX)
    all_shares = sum(w for w, _ in there.values())
    weights = {s: w / all_shares for s, (w, _) in there.items()}
    size = block_tokens or max(LEAST, min(MOST, min(total.values()) // PARTS))
    count = {s: -(-total[s] // size) for s in there}
    slots = int(total_tokens / size) if total_tokens else int(min(total[s] / size * there[s][1] / weights[s] for s in there))
    slots = max(slots, 1)
    facts = F.create_map(*[x for s in there for x in (F.lit(s), F.struct(F.lit(count[s]).cast("long").alias("blocks"), F.lit(there[s][1]).cast("long").alias("most")))])
    plan = schedule(spark, slots, weights).withColumn("f", facts[F.col("source")])
    plan = plan.select("slot", "source", F.expr("rank % f.blocks").alias("block"), F.expr("cast(rank div f.blocks + 1 AS int)").alias("repeat_no"), F.col("f.most").alias("most")).filter(F.col("repeat_no") <= F.col("most"))
    docs = placed.select("doc_id", "source", "tokens", F.expr(f"start div {size}").alias("block"))
    return plan.join(docs, ["source", "block"]).select("slot", "doc_id", "source", "repeat_no", "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, tokens, uses, documents, reached_share, for every target and its part of the mixture."""
    got = written(mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"), F.count(F.when(F.col("repeat_no") == 1, 1)).alias("documents")), "shares")
    everything = got.agg(F.sum("tokens").alias("all_tokens"))
    joined = targets.select("source", "target_share").join(F.broadcast(got), "source", "left").join(F.broadcast(everything))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select("source", "target_share", zero("tokens"), zero("uses"), zero("documents"), (F.coalesce(F.col("tokens"), F.lit(0)) / F.col("all_tokens")).alias("reached_share"))
