"""Exact percentiles of large groups: equal values counted together, in one order over all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecast.operators.ordered import in_order, running


def ranked(rows: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """``keys, _x, n, _first, _last``: each distinct value with the ranks, from 0, that its rows have: _first to _last - 1 of n.

    Null and NaN values have no rank. Tasks hold equally many values wherever these lie, so neither a heavy value nor one far off gathers a group.
    """
    # Missing values fall out with the counts, so that no filter repeats what a column is computed from.
    counted = rows.select(*keys, F.nullif(F.col(value).cast("double"), F.lit(float("nan"))).alias("_x")).groupBy(*keys, "_x").agg(F.count("_x").alias("_c")).where("_c > 0")
    told = running(in_order(counted, [*keys, "_x"]), keys, ["_x"], sums=("_c",))
    return told.select(*keys, "_x", F.col("_c_all").alias("n"), F.col("_c_before").alias("_first"), (F.col("_c_before") + F.col("_c")).alias("_last"))


def exact_percentiles(rows: DataFrame, keys: list[str], percents: tuple[float, ...], value: str = "v") -> DataFrame:
    """``keys, n, p0, p1, ..``: percentiles of finite values, linearly interpolated between order statistics.

    What is kept of a group are its wanted order statistics. A group without values has no row.
    """
    found = []

    def order(rank):
        return F.min(F.when((F.col("_first") <= rank) & (rank < F.col("_last")), F.col("_x")))

    for i, p in enumerate(percents):
        low = F.floor((F.col("n") - 1) * F.lit(p / 100))
        found += [order(low).alias(f"_l{i}"), order(F.least(low + 1, F.col("n") - 1)).alias(f"_h{i}")]
    picked = ranked(rows, keys, value).groupBy(*keys, "n").agg(*found)
    return picked.select(*keys, "n", *((F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * ((F.col("n") - 1) * F.lit(p / 100) - F.floor((F.col("n") - 1) * F.lit(p / 100)))).alias(f"p{i}") for i, p in enumerate(percents)))


def even_quantiles(rows: DataFrame, keys: list[str], most: int, value: str = "v", into: str = "quantiles") -> DataFrame:
    """``keys, quantiles``: all values in order of groups with up to ``most``, else ``most`` evenly spaced quantiles; an array of no more than that.

    Each value tells which of the wanted ranks are its own, so only those are gathered.
    """
    told = ranked(rows, keys, value)
    share = F.lit(most - 1)

    def place(i):
        return (F.col("n") - 1) * (i / share)

    # The places that a value can hold or be next to, by the inverse of the place and one more at each end.
    low = F.greatest(F.floor((F.col("_first") - 1) * share / (F.col("n") - 1)) - 1, F.lit(0))
    high = F.least(F.ceil(F.col("_last") * share / (F.col("n") - 1)) + 1, share)

    def holds(rank):
        return (F.col("_first") <= rank) & (rank < F.col("_last"))

    above = lambda i: F.least(F.floor(place(i)) + 1, F.col("n") - 1)
    wanted = F.filter(F.sequence(low.cast("long"), high.cast("long")), lambda i: holds(F.floor(place(i))) | holds(above(i)))
    large = told.where(F.col("n") > most).select("*", F.explode(wanted).alias("_i"))
    at = F.col("_i")
    ends = large.groupBy(*keys, "n", "_i").agg(*(F.max(F.when(holds(r), F.col("_x"))).alias(c) for c, r in (("_l", F.floor(place(at))), ("_h", above(at)))))
    valued = ends.select(*keys, F.struct("_i", (F.col("_l") + (F.col("_h") - F.col("_l")) * (place(at) - F.floor(place(at)))).alias("q")).alias("_q"))
    many = valued.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("_q")), lambda s: s["q"]).alias(into))
    few = told.where(F.col("n") <= most).groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_x", (F.col("_last") - F.col("_first")).cast("int").alias("c")))), lambda s: F.array_repeat(s["_x"], s["c"]))).alias(into))
    return few.unionByName(many)
