"""Exact quantiles and score ranks of groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one task. Here a mergeable sketch
brackets each quantile, brackets are narrowed by counting in sub-ranges until few values are left
in each, and only those are ordered, so a group holding most of the table is still spread over all
tasks and no task orders more than a set number of values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import bounded, join_bounded
from ..functions.places import with_place

SKETCH_ACCURACY = 10_000
CHUNKS = 256
MOST_ORDERED = 10_000
SUB_RANGES = 256
BELOW, INSIDE, ABOVE = 0, 1, 2


def exact_quantiles(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    name: str = "quantiles",
    accuracy: int = SKETCH_ACCURACY,
    most_ordered: int = MOST_ORDERED,
) -> DataFrame:
    """Linearly interpolated quantiles per group as one array column.

    The sketch misses a rank by at most ``n / accuracy``; brackets are twice as
    wide on each side, and the nearest values outside a bracket are kept, so
    both neighbouring order statistics of every quantile are found exactly. A bracket
    that may hold more than ``most_ordered`` values is narrowed first. A quantile that no
    bracket holds stops the query.
    """
    keys = list(keys)
    rows = frame.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    margin = 2.0 / accuracy
    bounds = [max(p - margin, 0.0) for p in probabilities]
    bounds += [min(p + margin, 1.0) for p in probabilities]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", bounds, accuracy).alias("_b"),
    )
    brackets = bounded(sketch)
    largest = sketch.agg(F.max("_n")).first()[0] or 0
    if 2 * margin * largest > most_ordered:
        brackets = bounded(_narrowed(rows, keys, brackets, probabilities, most_ordered))
    bracketed = rows.join(brackets, keys)
    zones = (
        _in_zones(bracketed, keys, len(probabilities), F.col("_v"))
        .groupBy(*keys, "_n", "_j", "_zone", "_key")
        .agg(F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_max"), F.min("_v").alias("_min"))
    )
    ranked = _ranked(zones, keys, probabilities, "_key")

    def statistic(rank: Column) -> Column:
        inside = (F.col("_zone") == INSIDE) & rank.between(F.col("_first"), F.col("_last"))
        return F.max(
            F.when(inside, F.col("_key"))
            .when((F.col("_zone") == BELOW) & (rank == F.col("_last")), F.col("_max"))
            .when((F.col("_zone") == ABOVE) & (rank == F.col("_first")), F.col("_min"))
        )

    picked = ranked.groupBy(*keys, "_j", "_position").agg(
        statistic(F.floor("_position")).alias("_low"),
        statistic(F.ceil("_position")).alias("_high"),
    )
    interpolated = F.col("_low") + (F.col("_high") - F.col("_low")) * (
        F.col("_position") - F.floor("_position")
    )
    missed = F.raise_error(F.lit("A quantile lies outside its bracket"))
    found = F.when(interpolated.isNotNull(), interpolated).otherwise(missed.cast("double"))
    listed = F.array_sort(F.collect_list(F.struct("_j", found.alias("q"))))
    return picked.groupBy(*keys).agg(listed.getField("q").alias(name))


def counted_quantiles(
    frame: DataFrame, keys: Sequence[str], value: str, weight: str, probabilities: Sequence[float], name: str
) -> DataFrame:
    """The same quantiles of rows that stand for ``weight`` equal records each.

    A group's distinct values are ordered in one task, so there must be few of them: scores of a grid.
    """
    keys = list(keys)
    values = (
        frame.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.sum(weight).alias("_c"))
    )
    group = Window.partitionBy(*keys)
    levels = F.array(*[F.struct(F.lit(j).alias("_j"), F.lit(float(p)).alias("_p")) for j, p in enumerate(probabilities)])
    ranked = (
        values.withColumns({"_last": F.sum("_c").over(group.orderBy("_v")) - 1, "_n": F.sum("_c").over(group)})
        .select("*", F.inline(levels))
        .withColumns({"_first": F.col("_last") - F.col("_c") + 1, "_position": F.col("_p") * (F.col("_n") - 1)})
    )

    def statistic(rank: Column) -> Column:
        return F.max(F.when(rank.between(F.col("_first"), F.col("_last")), F.col("_v")))

    picked = ranked.groupBy(*keys, "_j", "_position").agg(
        statistic(F.floor("_position")).alias("_low"), statistic(F.ceil("_position")).alias("_high")
    )
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_position") - F.floor("_position"))
    listed = F.array_sort(F.collect_list(F.struct("_j", between.alias("q"))))
    return picked.groupBy(*keys).agg(listed.getField("q").alias(name))


def _in_zones(bracketed: DataFrame, keys: list[str], count: int, inside: Column) -> DataFrame:
    """A row for each value and quantile: its zone, and ``inside`` as the key of those within the bracket."""
    v, entries = F.col("_v"), []
    for j in range(count):
        low, high = F.get("_b", F.lit(j)), F.get("_b", F.lit(count + j))
        zone = F.when(v < low, BELOW).when(v > high, ABOVE).otherwise(INSIDE)
        entries.append(
            F.struct(
                F.lit(j).alias("_j"),
                zone.alias("_zone"),
                F.when(v.between(low, high), inside).alias("_key"),
                v.alias("_v"),
            )
        )
    return bracketed.select(*keys, "_n", F.inline(F.array(*entries)))


def _ranked(zones: DataFrame, keys: list[str], probabilities: Sequence[float], key: str) -> DataFrame:
    """First and last rank of each zone or key, and the position of the quantile."""
    running = Window.partitionBy(*keys, "_j").orderBy("_zone", key)
    level = F.get(F.array(*[F.lit(float(p)) for p in probabilities]), F.col("_j"))
    return zones.withColumns(
        {"_last": F.sum("_c").over(running) - 1, "_position": level * (F.col("_n") - 1)}
    ).withColumn("_first", F.col("_last") - F.col("_c") + 1)


def _narrowed(
    rows: DataFrame, keys: list[str], brackets: DataFrame, probabilities: Sequence[float], most_ordered: int
) -> DataFrame:
    """Brackets that hold at most ``most_ordered`` values each, or one value many times.

    A pass cuts every bracket into equal sub-ranges and keeps the least and largest value of those that
    hold the two order statistics of its quantile. A bracket that no pass can narrow has few
    distinct values.
    """
    count = len(probabilities)
    while True:
        low = F.get("_b", F.col("_j"))
        high = F.get("_b", F.col("_j") + count)
        width = (high - low) / SUB_RANGES
        part = F.when(width > 0, F.least(F.floor((F.col("_v") - low) / width), F.lit(SUB_RANGES - 1))).otherwise(0)
        bracketed = rows.join(brackets, keys)
        exploded = bracketed.select(
            *keys, "_n", "_b", "_v", F.explode(F.array(*[F.lit(j) for j in range(count)])).alias("_j")
        )
        zone = F.when(F.col("_v") < low, BELOW).when(F.col("_v") > high, ABOVE).otherwise(INSIDE)
        counted = (
            exploded.select(*keys, "_n", "_j", zone.alias("_zone"), F.when(zone == INSIDE, part).alias("_part"), "_v")
            .groupBy(*keys, "_n", "_j", "_zone", "_part")
            .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        )
        ranked = _ranked(counted, keys, probabilities, "_part")
        below, above = F.floor("_position"), F.ceil("_position")
        holds = (F.col("_first") <= above) & (F.col("_last") >= below)
        # The value next to a bracket may be one of the two; a rank beyond it widens the bracket again.
        lowest = F.when((F.col("_zone") == BELOW) & (below == F.col("_last")), F.col("_max")).otherwise(F.col("_min"))
        highest = F.when((F.col("_zone") == ABOVE) & (above == F.col("_first")), F.col("_min")).otherwise(F.col("_max"))
        kept = (
            ranked.where(holds)
            .withColumns({"_low": lowest, "_high": highest})
            .groupBy(*keys, "_n", "_j")
            .agg(
                F.min("_low").alias("_low"),
                F.max("_high").alias("_high"),
                F.sum(F.when(F.col("_low") < F.col("_high"), F.col("_c")).otherwise(0)).alias("_held"),
            )
        )
        ordered = F.array_sort(F.collect_list(F.struct("_j", "_low", "_high")))
        table = (
            kept.groupBy(*keys, "_n")
            .agg(ordered.alias("_o"), F.max("_held").alias("_most"))
            .select(*keys, "_n", F.concat("_o._low", "_o._high").alias("_b"), "_most")
            .persist()
        )
        most = table.agg(F.max("_most")).first()[0] or 0
        same = table.join(brackets.select(*keys, F.col("_b").alias("_old")), keys).where("_b != _old").isEmpty()
        brackets = bounded(table.drop("_most"))
        if most <= most_ordered or same:
            return brackets


def interior_cuts(quantiles: Column) -> Column:
    """Sorted distinct cuts: tied quantiles collapse into one bin edge."""
    return F.array_sort(F.array_distinct(quantiles))


def decile_probabilities(n_bins: int) -> list[float]:
    return [position / n_bins for position in range(1, n_bins)]


def score_ranks(
    frame: DataFrame, keys: Sequence[str], score: str, positive: Column
) -> DataFrame:
    """Distinct scores of each group with the counts strictly above them.

    Equal scores are counted together first. A prefix sum over one group would
    put a large group into one task, so scores are cut into sketch-balanced
    chunks: chunk totals give the offset, and the running sum stays in a chunk.
    """
    keys = list(keys)
    n_chunks = CHUNKS
    rows = frame.select(*keys, F.col(score).alias("score"), positive.alias("_y"))
    levels = [position / n_chunks for position in range(1, n_chunks)]
    cuts = rows.groupBy(*keys).agg(
        F.percentile_approx("score", levels, SKETCH_ACCURACY).alias("_cuts")
    )
    counts = rows.groupBy(*keys, "score").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_y").alias("n_positive")
    )
    chunked = with_place(
        counts.join(bounded(cuts), keys), F.col("score"), F.col("_cuts"), n_chunks - 1, "chunk", lambda cut, v: cut <= v
    ).drop("_cuts")
    totals = chunked.groupBy(*keys, "chunk").agg(
        F.sum("n").alias("_n"), F.sum("n_positive").alias("_p")
    )
    above = (
        Window.partitionBy(*keys)
        .orderBy(F.col("chunk").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys,
        "chunk",
        F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p0"),
    )
    inside = (
        Window.partitionBy(*keys, "chunk")
        .orderBy(F.col("score").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = chunked.withColumns(
        {"_cn": F.sum("n").over(inside), "_cp": F.sum("n_positive").over(inside)}
    )
    return join_bounded(ranked, offsets, [*keys, "chunk"]).select(
        *keys,
        "score",
        "n",
        "n_positive",
        (F.col("_n0") + F.col("_cn") - F.col("n")).alias("n_above"),
        (F.col("_p0") + F.col("_cp") - F.col("n_positive")).alias("positive_above"),
    )
