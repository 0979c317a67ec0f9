"""Running totals and positions over a whole table, without one task seeing all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators.durable import cut

#: Groups whose first places are broadcast; of more, the join shuffles.
GROUPS_SENT = 1_000_000


def prefix_sum(df: DataFrame, order: list[str], value: Column, running: str = "running", part: str = "part") -> tuple[DataFrame, DataFrame]:
    """Rows with ``running`` (the inclusive total up to them, by ``order``, which must be unique) and ``part``, and the
    range [since, until) of each part. Rows are dealt by range of the order; only the parts' sums meet in one place. The
    names of the two new columns must not be those of columns given."""
    dealt = cut(df.withColumn("__v", value).repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sums = dealt.groupBy(part).agg(F.sum("__v").alias("__s"))
    until = F.sum("__s").over(W.orderBy(part))  # as many rows as partitions
    parts = cut(sums.select(part, (until - F.col("__s")).alias("since"), until.alias("until")))
    inner = F.sum("__v").over(W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    before = F.broadcast(parts.select(part, F.col("since").alias("__since")))
    return dealt.withColumn("__i", inner).join(before, part).withColumn(running, F.col("__since") + F.col("__i")).drop("__v", "__i", "__since"), parts


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``position``, from 0, by a unique order."""
    numbered = prefix_sum(df, order, F.lit(1).cast("long"), "__running", "__part")[0]
    return numbered.withColumn("position", F.col("__running") - 1).drop("__part", "__running")


def ranks(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Rows with their place, from 1, in their group by an order that is unique within it: a place in the whole table, less
    that of the group's first row, so no task sees all of a group."""
    numbered = cut(positions(df, [*group, *order]))
    first = numbered.groupBy(*group).agg(F.min("position").alias("__first"))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    found = numbered.alias("a").join(F.broadcast(first.alias("b")) if first.count() <= GROUPS_SENT else first.alias("b"), same)
    return found.select("a.*", (F.col("position") - F.col("__first") + 1).alias(name)).drop("position")


def cyclic(df: DataFrame, order: list[str], cursor: int, count: int) -> DataFrame:
    """``count`` rows from position ``cursor`` on, wrapping around, with their place in the slice."""
    numbered = positions(df, order)
    n = df.count()
    if not n:
        return numbered.withColumn("place", F.col("position"))
    first = F.pmod(F.col("position") - cursor, F.lit(n))
    turns = F.sequence(F.lit(0).cast("long"), F.floor((F.lit(count) - 1 - first) / n).cast("long"))
    return numbered.where(first < count).withColumn("turn", F.explode(turns)).withColumn("place", first + F.col("turn") * n).drop("turn")


def pad_to_multiple(df: DataFrame, order: list[str], size: int | None) -> DataFrame:
    """Appends the first rows, again and again, until the number of rows is a multiple of ``size``."""
    rows = df.withColumn("repeated_sample", F.lit(False))
    n = df.count() if size else 0
    if not n or not (missing := -n % size):
        return rows
    # fewer than `size` rows: a bound of the caller
    first = df.orderBy(*order).limit(min(missing, n))
    index = F.row_number().over(W.orderBy(*order)) - 1
    copies = F.sequence(F.lit(0), F.floor((F.lit(missing) - 1 - F.col("__i")) / n).cast("int"))
    extra = first.withColumn("__i", index).withColumn("__c", F.explode(copies)).drop("__i", "__c").withColumn("repeated_sample", F.lit(True))
    return rows.unionByName(extra)
