"""Operators on order: dense numbering, first rows of groups, neighbours, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, keep


def _ranges(df: DataFrame, order: list, scratch: Scratch | None) -> DataFrame:
    """df kept in sorted ranges, with the range's number as _part and the row's place in the table as _at."""
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return (scratch.keep if scratch else keep)(placed, "ranges").withColumn("_part", F.shiftright("_at", 33))


def _offsets(placed: DataFrame, **sums: Column) -> tuple[DataFrame, dict[str, float]]:
    """(_part and, by name, the sum of all ranges before; the sum of all). A row a range comes to the driver."""
    each = placed.groupBy("_part").agg(*(x.alias(c) for c, x in sums.items())).orderBy("_part")
    kinds = {f.name: f.dataType.simpleString() for f in each.schema.fields if f.name in sums}
    upto, out = {c: 0.0 if kind == "double" else 0 for c, kind in kinds.items()}, []
    for r in each.collect():
        out.append((r["_part"], *upto.values()))
        upto = {c: upto[c] + (r[c] or 0) for c in sums}
    return placed.sparkSession.createDataFrame(out, "_part long, " + ", ".join(f"{c} {kind}" for c, kind in kinds.items())), upto


def dense_index(df: DataFrame, order: list, name: str = "node_id", scratch: Scratch | None = None) -> DataFrame:
    """df with 0-based numbers in global order, without putting all rows in one task: sorted ranges, then an offset for each. The broadcast side has a row per range. The kept ranges go with scratch, if that is given."""
    placed = _ranges(df, order, scratch)
    before, _ = _offsets(placed, _before=F.count(F.lit(1)))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + inside).drop("_at", "_part", "_before")


def running_sums(df: DataFrame, order: list, columns: list[str], scratch: Scratch | None = None) -> tuple[DataFrame, dict[str, float]]:
    """(df with, for each column, the sum of the rows before in the order as `c_before`; the sums of all rows). Sums within sorted ranges, then an offset for each range, so no task has all rows. Nulls count as 0; of rows that are alike in the order any may come first."""
    placed = _ranges(df, order, scratch)
    before, total = _offsets(placed, **{f"_o_{c}": F.sum(c) for c in columns})
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_w_{c}") for c in columns))
    out = summed.join(F.broadcast(before), "_part").select(*df.columns, *((F.col(f"_w_{c}") + F.col(f"_o_{c}")).alias(f"{c}_before") for c in columns))
    return out, {c: total[f"_o_{c}"] for c in columns}


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each group. (Window group limits cut the rows before the shuffle.)"""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def adjacent(df: DataFrame, keys: list[str], order: list[Column | str], column: str) -> DataFrame:
    """Each row of a group with the row before it: keys, element, previous."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select(*keys, F.col(column).alias("element"), F.lag(column).over(w).alias("previous")).filter(F.col("previous").isNotNull())


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values: keys, run (from 0), value, first (its first order value), size."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("long"))
    marked = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    return marked.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.count(F.lit(1)).alias("size"))


def forward_fill(df: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    return df.withColumn(column, F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
