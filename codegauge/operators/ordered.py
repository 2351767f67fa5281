"""Positions and neighbours in ordered groups of any size.

A group may hold a large share of all rows, so no window runs over a whole
group that may have more than ``WHOLE_GROUP`` rows. Rows of those are cut into
chunks that follow the order; windows run inside a chunk, and a small table with
one row per chunk carries what a chunk must know about the ones before and
after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegauge.workspace import shared_folder

WHOLE_GROUP = 100_000  # rows that one window may hold
COUNTERS = 1 << 16


def in_large_groups(rows: DataFrame, keys: Sequence[str]) -> Column | None:
    """Whether a row's group may have more than ``WHOLE_GROUP`` rows, or None if none has.

    Rows are counted by a hash of their group in a table of fixed size, so what is shuffled does not
    grow with the number of groups. Groups that share a counter are judged together.
    """
    counter = F.pmod(F.xxhash64(*keys), F.lit(COUNTERS)).cast("int")
    counts = rows.select(counter.alias("__at")).groupBy("__at").agg(F.count(F.lit(1)).alias("__n"))
    large = [r["__at"] for r in counts.where(F.col("__n") > WHOLE_GROUP).select("__at").collect()]  # at most COUNTERS
    if not large:
        return None
    marks = bytearray(COUNTERS)
    for at in large:
        marks[at] = 1
    return F.substring(F.lit(bytes(marks)), counter + 1, F.lit(1)) == F.lit(b"\x01")


def with_neighbours(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, chunk: Column
) -> DataFrame:
    """Adds position, group_size, next and previous ``value`` with wrap-around.

    ``order`` must be total within a group; ``chunk`` must not decrease along it
    and should hold some thousands of rows. Where many rows of a group share the
    first order column, a struct of it and a coarse form of the second one (a
    prefix, a quotient) is a chunk too. Rows without a key or a chunk are left out;
    the latter count in their group.

    Groups are counted first. Rows of ordinary groups are shuffled once, for one window per
    group; only those of large groups go through chunks.
    """
    large = in_large_groups(rows, keys)
    if large is None:
        return _with_neighbours_in_groups(rows, keys, order, value, chunk)
    ordinary = _with_neighbours_in_groups(rows.where(~large), keys, order, value, chunk)
    return ordinary.unionByName(_with_neighbours_in_chunks(rows.where(large), keys, order, value, chunk))


def _with_neighbours_in_groups(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, chunk: Column
) -> DataFrame:
    given = F.lit(True)
    for k in keys:
        given &= F.col(k).isNotNull()
    inside = Window.partitionBy(*keys).orderBy(*order)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = rows.where(given).select(
        *rows.columns,
        chunk.isNotNull().alias("__stays"),
        F.row_number().over(inside).cast("long").alias("position"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
        F.coalesce(F.lead(value).over(inside), F.first(value).over(whole)).alias(f"next_{value}"),
        F.coalesce(F.lag(value).over(inside), F.last(value).over(whole)).alias(f"previous_{value}"),
    )
    return placed.where("__stays").drop("__stays")


def _with_neighbours_in_chunks(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, chunk: Column
) -> DataFrame:
    keys = list(keys)
    cut = rows.withColumn("__chunk", chunk)
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    local = cut.withColumns(
        {
            "__no": F.row_number().over(inside),
            "__next": F.lead(value).over(inside),
            "__prev": F.lag(value).over(inside),
        }
    )
    at = F.struct(*order, F.col(value).alias("__value"))
    chunks = cut.groupBy(*keys, "__chunk").agg(
        F.count(F.lit(1)).alias("__n"), F.min(at).alias("__low"), F.max(at).alias("__high")
    )
    along = Window.partitionBy(*keys).orderBy("__chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = chunks.select(
        *keys,
        "__chunk",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        F.sum("__n").over(whole).alias("group_size"),
        F.coalesce(F.lead("__low").over(along), F.first("__low").over(whole))["__value"].alias("__after"),
        F.coalesce(F.lag("__high").over(along), F.last("__high").over(whole))["__value"].alias("__before"),
    )
    joined = local.join(carried, [*keys, "__chunk"])
    return joined.select(
        *rows.columns,
        (F.col("__offset") + F.col("__no")).alias("position"),
        "group_size",
        F.coalesce("__next", "__after").alias(f"next_{value}"),
        F.coalesce("__prev", "__before").alias(f"previous_{value}"),
    )


def first_of_group(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group; pre-aggregated, so a large group stays cheap."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return rows.groupBy(*keys).agg(first).select(*keys, "first.*").select(*rows.columns)


def once_per_message(issues: DataFrame, word: str = "nesting") -> DataFrame:
    """Per file only the first issue of each message that contains a word; others stay."""
    repeated = F.contains(F.lower("message"), F.lit(word))
    first = first_of_group(
        issues.where(repeated), ["run_id", "path", "message"], ["line_number", "id"]
    )
    return issues.where(~F.coalesce(repeated, F.lit(False))).unionByName(first)


def sliding_count(
    events: DataFrame, key: str, time: str, seconds: int, chunk_windows: int = 10
) -> DataFrame:
    """Adds ``n``: events of the same key in the last ``seconds``, itself included.

    Time is cut into chunks of several window lengths. Each chunk also gets the
    events of one window length before it, so a count never needs another chunk
    and a busy key is spread over its chunks.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    width = seconds * 1_000_000
    span = width * chunk_windows
    own = F.floor(F.col("__t") / span)
    reach = F.floor((F.col("__t") + width) / span)
    spread = events.withColumn("__t", micros).select(
        "*", own.alias("__own"), F.explode(F.sequence(own, reach)).alias("__chunk")
    )
    window = (
        Window.partitionBy(key, "__chunk").orderBy("__t").rangeBetween(-width, Window.currentRow)
    )
    counted = spread.withColumn("n", F.count(F.lit(1)).over(window))
    return counted.where(F.col("__own") == F.col("__chunk")).select(*events.columns, "n")


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``, the position (from 1) of each row in its group; ``order`` must be total in it.

    For orders that no chunk expression follows, such as locale order. All rows are sorted once
    by ranges of (keys, order) and written with their place, because the bounds of the ranges
    are sampled and could differ if they were computed twice. What the groups hold in earlier
    ranges is then added from one row per range and group, at most as many rows of one group
    as there are ranges. A null key is a group of its own.
    """
    keys, spark = list(keys), rows.sparkSession
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    folder = shared_folder(spark, "numbered")
    placed = ranged.withColumns({"__range": F.spark_partition_id(), "__place": F.monotonically_increasing_id()})
    placed.write.parquet(folder)
    placed = spark.read.schema(placed.schema).parquet(folder)
    held = placed.groupBy("__range", *keys).agg(
        F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(
        F.col("__range").alias("__in"),
        *(F.col(k).alias(f"__of_{i}") for i, k in enumerate(keys)),
        (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) + 1 - F.col("__first")).alias("__shift"),
    )
    same = F.col("__range") == F.col("__in")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__of_{i}"))
    return placed.join(before, same).select(*rows.columns, (F.col("__place") + F.col("__shift")).alias(name))
