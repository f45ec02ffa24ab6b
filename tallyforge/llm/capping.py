"""At most so many records for each contributor, the best first.

One global range sort by contributor and the order of preference puts every contributor's records next to each
other, cut into partitions of like size wherever the cut falls: a contributor with a third of all rows is spread over
a third of the partitions.  Each partition reports its first and last contributor and the length of its last run (one
row a partition, so the driver adds them up), which gives the number of records of the first contributor that lie in
earlier partitions.  A second pass over the kept partitions subtracts each contributor's start from the running
position.

Defined cases: a null contributor is nobody, its rows never count and are left out; ties are broken by the last order
columns, which must be a key; an empty table gives no rows; extra columns are carried along untouched, but for one
named ``position``, which is replaced, and names that start with ``__cap_``, which are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyforge.session import shared_dir

POSITION = "position"
_KEY, _PID = "__cap_contributor", "__cap_pid"


def positions(df: DataFrame, contributor: Column, order: list[Column], partitions: int | None = None) -> DataFrame:
    """The rows with a contributor, with their 1-based ``position`` among that contributor's rows in ``order``."""
    spark = df.sparkSession
    shared_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.drop(POSITION).withColumn(_KEY, contributor).filter(F.col(_KEY).isNotNull())
    ranged = keyed.repartitionByRange(n, F.col(_KEY).asc(), *order).sortWithinPartitions(F.col(_KEY).asc(), *order)
    kept = ranged.checkpoint()  # both passes must see the same partitions

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = pid = None
        run = 0
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column(1)
            if first is None:
                first, pid = names[0].as_py(), b.column(0)[0].as_py()
            code, starts = _runs(names)
            tail = b.num_rows - int(starts[-1])
            end = names[b.num_rows - 1].as_py()
            run = run + b.num_rows if len(starts) == 1 and end == last else tail
            last = end
        if first is not None:
            yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "first": [first], "last": [last], "run": pa.array([run], pa.int64())})

    marked = kept.select(F.spark_partition_id().alias("pid"), F.col(_KEY))
    carry: dict[int, int] = {}
    before, count = None, 0
    for r in sorted(marked.mapInArrow(ends, "pid int, first string, last string, run long").collect()):
        carry[r.pid] = count if r.first == before else 0
        count = (carry[r.pid] + r.run) if r.first == r.last else r.run
        before = r.last

    schema = StructType([*[f for f in kept.schema.fields if f.name != _KEY], StructField(POSITION, LongType())])
    columns = [f.name for f in schema.fields[:-1]]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column(b.num_columns - 1)
            if last is None:
                last, seen = names[0].as_py(), carry[b.column(0)[0].as_py()]
            _, starts = _runs(names)
            length = np.diff(np.append(starts, b.num_rows))
            at = np.arange(b.num_rows) - np.repeat(starts, length) + 1
            if names[0].as_py() == last:
                at[: int(length[0])] += seen
            last, seen = names[b.num_rows - 1].as_py(), int(at[-1])
            yield pa.RecordBatch.from_arrays([*b.columns[1:-1], pa.array(at, pa.int64())], names=[*columns, POSITION])

    return kept.select(F.spark_partition_id().alias(_PID), *columns, _KEY).mapInArrow(place, schema)


def _runs(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Dictionary codes of a sorted column and the index at which each run of equal values starts."""
    code = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return code, np.flatnonzero(np.append(True, code[1:] != code[:-1]))


def over_cap(df: DataFrame, contributor: Column, order: list[Column], cap: int | None = None, share: float | None = None, partitions: int | None = None) -> DataFrame:
    """The rows beyond a contributor's first ``cap``, or beyond ``share`` of all rows with a contributor."""
    placed = positions(df, contributor, order, partitions)
    if share is not None:
        cap = int(share * placed.count())
    return placed.filter(F.col(POSITION) > cap)
