"""Continuous periods and gaps per entity, as a mergeable aggregate of disjoint intervals.

The aggregate's state is a sorted list of disjoint, non-touching intervals. Two states combine by a
linear merge, in any order, so they are reduced in a tree:

1. each input batch is reduced where it was read (no shuffle), one list per entity and time block;
2. the lists of one (entity, block) are merged ``FAN_IN`` at a time, level by level, until one is
   left; how many levels there are follows from the number of input tasks;
3. blocks of an entity are chained by running maxima over one row of two numbers per block, which
   tell every block where the period it continues began.

A block spans ``BLOCK_MS`` of start times at millisecond resolution, so a block's list is bounded
however many rows one entity has; no step gathers the intervals of an entity in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from spanwise.session import materialize

BLOCK_MS = 600_000
#: Lists merged by one row of a level of the tree at most, on average.
FAN_IN = 32
#: Tasks assumed where the size of the input is unknown, as it is for rows of other sources than files.
MOST_TASKS = 1_000_000
#: Rows a task reduces at a time.
PARTIAL_ROWS = 400_000
#: Bounds beyond this many milliseconds cannot be represented as a long after rounding.
_MAX_MS = 9.0e18


def disjoint(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals of intervals sorted by start, in linear time; touching ones join."""
    if len(start) == 0:
        return start, end
    reach = np.maximum.accumulate(end)
    at = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[at], reach[np.r_[at[1:] - 1, len(end) - 1]]


def merge_two(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The union of two states. Both are sorted, so each interval's place among the other's is found
    without sorting, and one pass over the merged order joins them."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    if len(b[0]) == 0:
        return a
    place = np.searchsorted(a[0], b[0]) + np.arange(len(b[0]))
    own = np.ones(len(a[0]) + len(b[0]), bool)
    own[place] = False
    start, end = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    start[place], end[place] = b
    start[own], end[own] = a
    return disjoint(start, end)


def merge_all(states: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The union of several states, merged in pairs, so that each interval is moved log n times."""
    while len(states) > 1:
        states = [merge_two(*states[i : i + 2]) if i + 1 < len(states) else states[i] for i in range(0, len(states), 2)]
    return states[0]


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds of a time in seconds, half away from zero; null for what is no finite long."""
    ms = F.round(seconds.cast("double") * 1000)
    return F.when(F.abs(ms) < _MAX_MS, ms.cast("long"))


def _partial_lists(df: DataFrame, block_ms: int) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("entity_kind", T.StringType()),
            T.StructField("entity_id", T.StringType()),
            T.StructField("block", T.LongType()),
            T.StructField("starts", T.ArrayType(T.LongType())),
            T.StructField("ends", T.ArrayType(T.LongType())),
        ]
    )

    def reduced(batch: pa.Table) -> pa.RecordBatch:
        start, end = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
        codes, keys = np.zeros(len(start), np.int64), []
        for i in (0, 1):
            d = batch.column(i).combine_chunks().dictionary_encode()
            keys.append(d.dictionary)
            codes = codes * max(1, len(d.dictionary)) + d.indices.to_numpy().astype(np.int64)
        blocks, block_code = np.unique(start // block_ms, return_inverse=True)
        code = codes * len(blocks) + block_code
        order = np.lexsort((start, code))  # raw rows come in any order: this is where the states begin
        code, start, end = code[order], start[order], end[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        lists = [disjoint(start[a:b], end[a:b]) for a, b in zip(first, np.r_[first[1:], len(code)], strict=True)]
        offsets = pa.array(np.r_[0, np.cumsum([len(s) for s, _ in lists])].astype(np.int32))
        own = code[first]
        entity, block_at = own // len(blocks), own % len(blocks)
        kind_at, id_at = entity // max(1, len(keys[1])), entity % max(1, len(keys[1]))
        s, e = (pa.array(np.concatenate([x[k] for x in lists])) for k in (0, 1))
        return pa.RecordBatch.from_arrays(
            [keys[0].take(pa.array(kind_at)), keys[1].take(pa.array(id_at)), pa.array(blocks[block_at]), pa.ListArray.from_arrays(offsets, s), pa.ListArray.from_arrays(offsets, e)],
            names=schema.fieldNames(),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PARTIAL_ROWS:
                yield reduced(pa.Table.from_batches(held))
                held = []
        if held:
            yield reduced(pa.Table.from_batches(held))

    return df.select("entity_kind", "entity_id", "start_ms", "end_ms").mapInArrow(run, schema)


def _combine(lists: DataFrame, keys: list[str]) -> DataFrame:
    """Merges the lists of equal ``keys`` into one; a list that is alone does not leave the JVM."""

    @F.pandas_udf("struct<starts: array<long>, ends: array<long>>")
    def linear_merge(starts, ends):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = [(None, None) if ss is None else merge_all([(np.asarray(s, np.int64), np.asarray(e, np.int64)) for s, e in zip(ss, es, strict=True)]) for ss, es in zip(starts, ends, strict=True)]
        return pd.DataFrame({"starts": [s for s, _ in rows], "ends": [e for _, e in rows]})

    one = lists.groupBy(*keys).agg(F.collect_list(F.struct("starts", "ends")).alias("states"))
    several, alone = F.size("states") > 1, F.element_at("states", 1)
    merged = one.withColumn("m", linear_merge(F.when(several, F.col("states.starts")), F.when(several, F.col("states.ends"))))
    return merged.select(*keys, *[F.when(several, F.col(f"m.{c}")).otherwise(alone[c]).alias(c) for c in ("starts", "ends")])


def _input_tasks(df: DataFrame) -> int:
    """About how many tasks read ``df``, by the size the optimizer assumes for it; only the fan-in depends on it."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    return max(spark.sparkContext.defaultParallelism, min(MOST_TASKS, -(-size // split)))


def coverage(intervals: DataFrame, block_ms: int = BLOCK_MS, fan_in: int = FAN_IN) -> DataFrame:
    """Periods and gaps of ``intervals`` (entity_kind, entity_id, start_ms, end_ms).

    Returns (entity_kind, entity_id, piece, start_ms, end_ms): a ``period`` for each maximal
    continuous stretch, a ``gap`` between two successive periods. Intervals that touch are
    continuous. Rows with a null, a negative start or an end not after the start are left out;
    a null entity is left out too. Repeated rows change nothing; no rows give no rows. Other columns
    are not carried.
    """
    ok = intervals.filter("entity_kind IS NOT NULL AND entity_id IS NOT NULL AND start_ms >= 0 AND end_ms > start_ms")
    entity = ["entity_kind", "entity_id"]
    blocks, left = _partial_lists(ok, block_ms).withColumn("salt", F.spark_partition_id()), _input_tasks(ok)
    while left > fan_in:  # every level leaves one of fan_in lists of a block
        left = -(-left // fan_in)
        blocks = _combine(blocks.withColumn("salt", F.pmod("salt", F.lit(left))), [*entity, "block", "salt"])
    blocks = _combine(blocks.drop("salt"), [*entity, "block"])
    return _chain(materialize(blocks), entity)


def _chain(blocks: DataFrame, entity: list[str]) -> DataFrame:
    """Periods and gaps of the blocks of each entity.

    Only the first start, the last end and the start of the last fresh interval of a block pass
    through the windows; lists stay out of them and meet these numbers by an equi-join.
    """
    key = [*entity, "block"]
    before = W.Window.partitionBy(*entity).orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    ends = blocks.select(*key, F.element_at("ends", -1).alias("last_end"), F.element_at("starts", -1).alias("last_start"))
    reached = ends.withColumn("reach", F.max("last_end").over(before))
    # intervals of a block are disjoint: only those that start within the carried reach continue it.
    # The last interval of a block opens a period unless it is itself within the reach
    opens = F.when(F.col("reach").isNull() | (F.col("last_start") > F.col("reach")), F.col("last_start"))
    short = reached.withColumn("opened", F.max(opens).over(before)).select(*key, "reach", "opened")
    carried = blocks.join(short, key).withColumn("n_old", F.coalesce(F.size(F.filter("starts", lambda s: s <= F.col("reach"))), F.lit(0)))
    n_old, n = F.col("n_old"), F.size("starts")

    def piece(name: str, s: Column, e: Column) -> Column:
        return F.struct(F.lit(name).alias("piece"), s.alias("s"), e.alias("e"))

    # the part of a period that lies in this block: intervals before the first fresh one belong to
    # the period opened earlier; a fresh one closes the gap since everything before it ended
    none = F.array().cast("array<struct<piece: string, s: bigint, e: bigint>>")
    head = F.when(n_old > 0, F.array(piece("period", F.col("opened"), F.element_at("ends", n_old))))
    fresh = F.slice("starts", n_old + 1, n - n_old)
    rest = F.zip_with(fresh, F.slice("ends", n_old + 1, n - n_old), lambda s, e: piece("period", s, e))
    gaps = F.transform(fresh, lambda s, i: piece("gap", F.greatest(F.col("reach"), F.try_element_at("ends", F.when(n_old + i > 0, n_old + i))), s))
    parts = carried.select(*entity, F.explode(F.concat(F.coalesce(head, none), rest, F.filter(gaps, lambda x: x["s"].isNotNull()))).alias("p"))
    return parts.groupBy(*entity, F.col("p.piece").alias("piece"), F.col("p.s").alias("start_ms")).agg(F.max("p.e").alias("end_ms"))
