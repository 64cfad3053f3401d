"""Null, tie and rounding rules that every operator shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaled(x: Column, places: int = 6) -> Column:
    """A ratio as a whole number of 10^-places, half up: engines agree on it where they differ in printing doubles."""
    return F.floor(x * 10**places + 0.5).cast("long")


def decade(year: Column) -> Column:
    return (year - year % 10).cast("long")


def top_n(df: DataFrame, group: list[str], order: list, n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; ``order`` must end in a unique key."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page under a total order: late columns are better joined to the page than sorted with it."""
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)


def names(col: str) -> Column:
    """A set of names as one text, in order."""
    return F.array_join(F.sort_array(F.collect_set(F.col(col).cast("string"))), "|")


def running_sums(lengths: Column, block: int = 16, levels: int = 2) -> Column:
    """For each place of an array of ints, the sum of the elements before it: blocks are summed first, and blocks of these, so that an element takes some ``block`` / 2 steps in a long array too."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    plain = lambda xs: F.transform(xs, lambda _, i: total(F.slice(xs, F.lit(1), i)))

    def of(xs: Column, level: int) -> Column:
        if not level:
            return plain(xs)
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: total(F.slice(xs, b * block + 1, F.lit(block))))
        place = lambda ss: F.transform(xs, lambda _, i: F.get(ss, F.floor(i / block).cast("int")) + total(F.slice(xs, i - i % block + 1, i % block)))
        return let(let(parts, lambda ps: of(ps, level - 1)), place)

    return F.when(F.size(lengths) > 0, let(lengths, lambda xs: of(xs, levels))).otherwise(F.array().cast("array<int>"))
