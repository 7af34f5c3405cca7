"""Orders over whole tables without one task: rows are dealt by ranges, and one row a range tells what lies before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut


def _parts(df: DataFrame) -> int:
    """Ranges for every core, and as many as a shuffle has."""
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _same(pairs: list[tuple[str, str]]) -> Column:
    """All pairs of columns equal; nulls are equal too."""
    out = F.lit(True)
    for a, b in pairs:
        out &= F.col(a).eqNullSafe(F.col(b))
    return out


def dealt(rows: DataFrame, by: list[str], order: list[Column | str], size: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with _range, sizes): the rows written by ranges of group and order, and (by.., _range, _size, _before, _total) where a size is summed by group and range.

    The ranges of a group follow one another; a hot group has several, and sizes have one row
    for each group of a range.
    """
    out = cut(rows.repartitionByRange(_parts(rows), *by, *order).withColumn("_range", F.spark_partition_id()))
    sizes = out.groupBy(*by, "_range").agg(F.coalesce(F.sum(size), F.lit(0)).alias("_size"))
    w = Window.partitionBy(*(by or [F.lit(0)]))
    before = F.sum("_size").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    return out, sizes.withColumns({"_before": before, "_total": F.sum("_size").over(w)})


def with_offsets(rows: DataFrame, sizes: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """Dealt rows with columns of their group's and range's sizes; rows whose range has none go."""
    keys = [*by, "_range"]
    return rows.alias("l").join(sizes.select(*keys, *columns).alias("r"), _same([(f"l.{k}", f"r.{k}") for k in keys])).select("l.*", *(f"r.{c}" for c in columns))


def numbered(rows: DataFrame, order: list[Column | str], name: str, by: list[str] = ()) -> DataFrame:
    """The rows with their place, from 1, in one order over all or in each group: each range numbers its own after those before it. Equals are numbered as they come."""
    by = list(by)
    out, sizes = dealt(rows, by, order, F.lit(1))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return with_offsets(out, sizes, by, "_before").withColumn(name, place.cast("long")).drop("_range", "_before")


def quantiles(rows: DataFrame, by: list[str], value: str, named: dict[str, float | Callable[[Column], Column]], *more: Column) -> DataFrame:
    """(by.., n, more.., one column for each name): exact quantiles by nearest rank, of all groups at once; nulls don't count, a group without values has none.

    A rank is ceil(q n), at least 1, or what a function makes of n; more are aggregates of a
    group's rows. Equal values are counted first, then dealt by ranges of group and value, and
    only the ranges that hold a rank are looked through.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    counts = rows.where(F.col(value).isNotNull()).groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    out, sizes = dealt(counts, keys, ["_v"], F.col("_n"))
    rank = lambda q: q(F.col("_total")) if callable(q) else F.ceil(F.lit(q) * F.col("_total"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.least(F.col("_total"), rank(q))).cast("long").alias("rank")) for name, q in named.items()))
    asked = sizes.withColumn("_want", F.filter(wanted, lambda x: (x.rank > F.col("_before")) & (x.rank <= F.col("_before") + F.col("_size")))).where(F.size("_want") > 0)
    near = with_offsets(out, asked, keys, "_before", "_want")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = near.withColumn("_upto", upto).withColumn("_hit", F.filter("_want", lambda x: (x.rank > F.col("_upto") - F.col("_n")) & (x.rank <= F.col("_upto"))))
    each = found.select(*keys, "_v", F.explode(F.transform("_hit", lambda x: x["name"])).alias("_name"))
    values = each.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in named))
    totals = rows.groupBy(*by).agg(F.count(value).alias("n"), *more)
    return totals.alias("t").join(values.alias("v"), _same([(f"t.{c}", f"v.{k}") for c, k in zip(by, keys, strict=True)]), "left").select("t.*", *(f"v.{name}" for name in named))
