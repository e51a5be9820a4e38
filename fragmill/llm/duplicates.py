"""Duplicates hidden by formatting differences.

Records are written in one canonical form, range-partitioned and sorted by it, and adjacent runs are scanned comparing
full keys. Runs are cut anywhere by the range boundaries (the id is part of the sort key), so a run of any length is
spread over as many tasks as its share of rows; the at most two cut runs of each partition are mended afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragmill.functions.text import fold
from fragmill.plans.lineage import Scratch
from fragmill.sources.tables import require


def canonical(columns: Sequence[str]) -> Column:
    """The folded values in sorted order, joined by a character that folding drops."""
    return F.array_join(F.sort_array(F.array(*[fold(F.col(f"`{c}`")) for c in columns])), "|")


def _scan(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Adjacent runs of one sorted partition: each row with its run's first id; then the first and the last run's key."""
    part = TaskContext.get().partitionId()
    key = head = first = None
    run = -1

    def edge(number, at, k):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.nulls(1, schema.field(2).type), pa.array([at], schema.field(3).type), pa.array([k], pa.string())], schema=schema)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, ids = batch.column(0).cast(pa.string()), batch.column(1)
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = keys[0].as_py() != key if run >= 0 else True
        starts = np.flatnonzero(new)
        where = np.cumsum(new)  # 0: the run carried over from the batch before
        heads = pa.array([head], ids.type) if run >= 0 else pa.nulls(1, ids.type)
        heads = pa.concat_arrays([heads, ids.take(pa.array(starts))])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(run + where.astype(np.int64)), ids, heads.take(pa.array(where)), pa.nulls(n, pa.string())], schema=schema)
        if first is None:
            first = (0, ids[0].as_py(), keys[0].as_py())
        run += int(where[-1])
        head, key = heads[int(where[-1])].as_py(), keys[n - 1].as_py()
    if run >= 0:
        yield edge(*first)
        if run > 0:
            yield edge(run, head, key)


def copies(df: DataFrame, id_col: str, columns: Sequence[str], partitions: int | None = None) -> DataFrame:
    """(row, representative): each row with the smallest id among the rows that state the same record.

    Same record: the same folded values of ``columns``, in whatever order. Null folds to the empty string, so rows
    whose columns are all null or blank are copies of each other. A row whose id is null is a row like any other; it
    represents a record only if all its copies' ids are null. Other columns are ignored, whatever their names. An
    empty table gives none.
    """
    require(df, [id_col, *columns])
    spark = df.sparkSession
    scratch = Scratch(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select(canonical(columns).alias("key"), F.col(f"`{id_col}`").alias("id"))
    order = [F.xxhash64("key"), F.col("key"), F.col("id").asc_nulls_last()]
    spread = keyed.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    kind = keyed.schema["id"].dataType
    out = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("row", kind), T.StructField("head", kind), T.StructField("edge", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    runs = scratch.keep(spread.mapInArrow(lambda it: _scan(it, arrow), out))
    # A run cut by a partition boundary continues in the next: by its key, among at most two runs of each partition.
    cut = runs.filter("edge is not null").groupBy("part", "run", "edge", "head").agg(F.count(F.lit(1)).alias("n"))
    whole = cut.groupBy("edge").agg(F.min("head").alias("true_head"), F.count(F.lit(1)).alias("pieces")).filter("pieces > 1")
    mend = cut.join(whole, "edge").select("part", "run", "true_head")
    rows = runs.filter("edge is null").join(F.broadcast(mend), ["part", "run"], "left")
    return rows.select("row", F.coalesce("true_head", "head").alias("representative"))


def collapse(df: DataFrame, id_col: str, columns: Sequence[str], partitions: int | None = None) -> DataFrame:
    """(representative, n_copies): one row a record, with the exact number of rows that state it."""
    return copies(df, id_col, columns, partitions).groupBy("representative").agg(F.count(F.lit(1)).alias("n_copies"))
