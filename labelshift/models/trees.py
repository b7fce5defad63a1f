"""Boosted-tree and forest density ratios, fitted on class sums of cells."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import DEFAULT, Domain
from ..functions.expressions import expit, indicator
from ..functions.local import small_table
from ..functions.storage import written
from ..operators.features import require_inputs
from ..operators.weights import equal_prior_weights, is_positive
from ..plans.folds import Fold
from ..plans.specifications import BoostingParameters
from . import boosting, forest
from .cells import Grid, cut_column, make_grid, quantile_cuts, with_scores

# The declared forest, and the least probability of a ratio.
FOREST_TREES = 50
FOREST_DEPTH = 10
FOREST_SEED = 17
LEAST_PROBABILITY = 1e-12

LARGEST_LOG_ODDS = float(np.log((1 - LEAST_PROBABILITY) / LEAST_PROBABILITY))
BOOSTING_BINS = 64
FOREST_BINS = 32
# Column of counted targets: the number of records of a row.
RECORDS = "n_records"


@dataclass(frozen=True)
class TreeModel:
    """A fitted ensemble as the log odds of every cell of its grid; they are the log ratio."""

    family: str
    identifier: str
    train_years: tuple[int, ...]
    grid: Grid
    cuts: tuple[tuple[float, ...], ...]
    scores: tuple[float, ...]
    feature_set: str = "core"
    domain: Domain = DEFAULT

    @property
    def model_id(self) -> str:
        return f"{self.identifier}__train_{self.train_years[0]}_{self.train_years[-1]}"

    def score_table(self, spark: SparkSession) -> DataFrame:
        """A row for each cell, as a local relation."""
        rows = pa.table(
            {"_cell": pa.array(np.arange(self.grid.n_cells, dtype=np.int32)), "_score": pa.array(self.scores)}
        )
        return spark.createDataFrame(rows)

    def log_ratio(self, frame: DataFrame, name: str = "log_ratio") -> DataFrame:
        """Null where an input is missing or a level is not declared."""
        placed = self.grid.with_cell(frame, [cut_column(c) for c in self.cuts], "_cell")
        table = F.broadcast(self.score_table(frame.sparkSession))
        scored = placed.join(table, "_cell", "left")
        return scored.select(*[F.col(f"`{c}`") for c in frame.columns if c != name], F.col("_score").alias(name))

    def counted_log_ratio(self, frame: DataFrame, keys: Sequence[str], name: str = "log_ratio") -> DataFrame:
        """Records counted by the keys and the cell, with the cell's log ratio."""
        placed = self.grid.with_cell(frame, [cut_column(c) for c in self.cuts], "_cell")
        counts = placed.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias(RECORDS))
        table = F.broadcast(self.score_table(frame.sparkSession))
        return counts.join(table, "_cell", "left").select(*keys, F.col("_score").alias(name), RECORDS)

    def probability(self, frame: DataFrame, name: str = "probability") -> DataFrame:
        return self.log_ratio(frame, "_ratio").withColumn(name, expit(F.col("_ratio"))).drop("_ratio")


def training_rows(records: DataFrame, years: Sequence[int], feature_set: str, domain: Domain) -> DataFrame:
    """Checked labelled records of the years with their equal-prior weights."""
    frame = records.where(F.col("year").isin(*years) & F.col(domain.label).isNotNull())
    require_inputs(frame, domain.inputs(feature_set), nulls_allowed=False, domain=domain)
    return equal_prior_weights(frame, domain=domain)


def _in_folds(rows: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    years = [(fold.fold_id, int(year)) for fold in folds for year in fold.train_years]
    return rows.join(F.broadcast(small_table(rows.sparkSession, years, "fold_id string, year int")), "year")


def _with_cells(rows: DataFrame, grid: Grid, cuts: DataFrame) -> DataFrame:
    columns = [F.col(f"_cuts_{place}") for place in range(len(grid.inputs))]
    placed = grid.with_cell(rows.join(F.broadcast(cuts), "fold_id"), columns, "cell")
    return placed.drop(*[f"_cuts_{place}" for place in range(len(grid.inputs))])


def fold_cells(
    records: DataFrame,
    folds: Sequence[Fold],
    grid: Grid,
    feature_set: str,
    domain: Domain,
    cuts: Sequence[Sequence[float]] | None = None,
) -> tuple[DataFrame, dict[str, list[list[float]]], DataFrame]:
    """Class sums of the training cells of each fold, the cuts of each fold, and both as a table."""
    years = sorted({year for fold in folds for year in fold.train_years})
    rows = _in_folds(training_rows(records, years, feature_set, domain), folds)
    if cuts is None:
        found = {k[0]: v for k, v in quantile_cuts(rows, ["fold_id"], grid.bins, feature_set, domain).items()}
    else:
        found = {fold.fold_id: [sorted(set(c)) for c in cuts] for fold in folds}
    names = ", ".join(f"_cuts_{place} array<double>" for place in range(len(grid.inputs)))
    table = small_table(records.sparkSession, [(k, *v) for k, v in found.items()], f"fold_id string, {names}")
    y, w = indicator(is_positive(domain)), F.col("source_weight")
    sums = (
        _with_cells(rows, grid, table)
        .groupBy("fold_id", "cell")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(w * y).alias("positive"),
            F.sum(w * (1 - y)).alias("negative"),
        )
    )
    return sums, found, table


def boosted_scores(
    cells: DataFrame, grid: Grid, candidates: Sequence[BoostingParameters], every_cell: bool = False
) -> DataFrame:
    """fold_id, parameter_id, cell, score: each fold and structure is one fit in a task of its own.

    ``cells`` holds the training sums of each fold and, with n = 0, other cells to be scored. Candidates
    that differ in the number of rounds alone share one fit, whose earlier rounds give their scores.
    """
    fits: dict[BoostingParameters, list[int]] = {}
    for p in candidates:
        shared = BoostingParameters(p.max_leaf_nodes, p.learning_rate, 0, p.l2_regularization, p.min_samples_leaf)
        fits.setdefault(shared, []).append(p.max_iter)
    jobs = list(fits.items())
    number = F.explode(F.array(*[F.lit(n) for n in range(len(jobs))])).alias("job")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        parameters, rounds = jobs[int(group["job"].iloc[0])]
        fold_id = group["fold_id"].iloc[0]
        group = group.groupby("cell", sort=True)[["n", "positive", "negative"]].sum()
        if every_cell:
            group = group.reindex(range(grid.n_cells), fill_value=0)
        places = group.index.to_numpy()
        own = boosting.Cells(
            grid.codes(places),
            group["n"].to_numpy(float),
            group["positive"].to_numpy(float),
            group["negative"].to_numpy(float),
        )
        parts = []
        for done, score in boosting.boost(grid, own, parameters, rounds).items():
            named = BoostingParameters(
                parameters.max_leaf_nodes,
                parameters.learning_rate,
                done,
                parameters.l2_regularization,
                parameters.min_samples_leaf,
            )
            clipped = np.clip(score, -LARGEST_LOG_ODDS, LARGEST_LOG_ODDS)
            parts.append(
                pd.DataFrame({"fold_id": fold_id, "parameter_id": named.identifier, "cell": places, "score": clipped})
            )
        return pd.concat(parts)

    return (
        cells.select("fold_id", "cell", "n", "positive", "negative", number)
        .repartition(max(1, 4 * len(jobs)), "fold_id", "job")
        .groupBy("fold_id", "job")
        .applyInPandas(fit, "fold_id string, parameter_id string, cell int, score double")
    )


def boosted_log_ratios(
    records: DataFrame,
    targets: DataFrame,
    folds: Sequence[Fold],
    candidates: Sequence[BoostingParameters],
    *,
    feature_set: str = "core",
    domain: Domain = DEFAULT,
    bins: int = BOOSTING_BINS,
    counted: Sequence[str] | None = None,
) -> DataFrame:
    """The target records (with ``fold_id``) once for each candidate, with its log ratio.

    Records that agree in a cell have the same log ratios. With ``counted``, columns that include
    ``fold_id``, they are counted by these and the cell first (``RECORDS``), and a candidate's rows
    are bounded by the cells of the grid, whatever the number of records.
    """
    grid = make_grid(bins, feature_set, domain)
    sums, _, cuts = fold_cells(records, folds, grid, feature_set, domain)
    placed = _with_cells(targets, grid, cuts)
    if counted is not None:
        placed = written(placed.groupBy(*counted, "cell").agg(F.count(F.lit(1)).alias(RECORDS)))
    other = placed.select(
        "fold_id", "cell", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("positive"), F.lit(0.0).alias("negative")
    ).distinct()
    scores = boosted_scores(sums.unionByName(other), grid, candidates).withColumnRenamed("score", "log_ratio")
    return with_scores(placed, scores, ["fold_id", "cell"]).drop("cell")


def fit_boosting(
    records: DataFrame,
    parameters: BoostingParameters,
    train_years: Sequence[int],
    *,
    feature_set: str = "core",
    domain: Domain = DEFAULT,
    bins: int = BOOSTING_BINS,
    cuts: Sequence[Sequence[float]] | None = None,
) -> TreeModel:
    """Equal-prior boosted trees with their leaf budget and leaf penalty; ``cuts`` replaces quantiles."""
    years = tuple(sorted(train_years))
    whole = Fold(years, (years[-1] + 1,), "forward")  # only its training years are read
    grid = make_grid(bins, feature_set, domain)
    sums, found, _ = fold_cells(records, [whole], grid, feature_set, domain, cuts)
    table = boosted_scores(sums, grid, [parameters], every_cell=True).select("cell", "score").toPandas()
    prefix = "boosting" if feature_set == "core" else f"boosting_{feature_set}"
    return TreeModel(
        "hist_gradient_boosting",
        f"{prefix}__{parameters.identifier}",
        years,
        grid,
        tuple(tuple(c) for c in found[whole.fold_id]),
        tuple(table.sort_values("cell")["score"].tolist()),
        feature_set,
        domain,
    )


def fit_forest(
    records: DataFrame, train_years: Sequence[int], *, domain: Domain = DEFAULT, bins: int = FOREST_BINS
) -> TreeModel:
    """Equal-prior forest of the declared size on indicators of all levels; each tree is a task.

    The tasks share a table of class counts by cell and year, of at most twice the cells times the years.
    """
    years = tuple(sorted(train_years))
    grid = make_grid(bins, "core", domain)
    rows = training_rows(records, years, "core", domain)
    cuts = quantile_cuts(rows.withColumn("_all", F.lit(0)), ["_all"], bins, "core", domain)[(0,)]
    counted = (
        grid.with_cell(rows, [cut_column(c) for c in cuts], "cell")
        .groupBy("cell", "year", indicator(is_positive(domain)).alias("positive"))
        .agg(F.count(F.lit(1)).alias("n"), F.first("source_weight").alias("weight"))
        .toPandas()
        .sort_values(["cell", "year", "positive"])
    )
    spark = records.sparkSession
    shared = spark.sparkContext.broadcast(
        tuple(counted[name].to_numpy() for name in ("cell", "positive", "n", "weight"))
    )

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, positive, n, weight = shared.value
        codes = grid.codes(np.arange(grid.n_cells))
        for batch in batches:
            for tree in batch["id"]:
                random = np.random.default_rng([FOREST_SEED, int(tree)])
                drawn = random.poisson(n) * weight
                sums = [np.bincount(cell, drawn * (positive == y), grid.n_cells) for y in (1, 0)]
                share = forest.gini_tree(grid, codes, *sums, FOREST_DEPTH, random)
                yield pd.DataFrame({"tree": [tree], "share": [share.tobytes()]})

    grown = spark.range(0, FOREST_TREES, 1, FOREST_TREES).mapInPandas(grow, "tree long, share binary").collect()
    shares = [np.frombuffer(row.share) for row in sorted(grown, key=lambda row: row.tree)]
    p = np.clip(np.mean(shares, axis=0), LEAST_PROBABILITY, 1 - LEAST_PROBABILITY)
    identifier = f"random_forest__rf_{FOREST_TREES}_depth_{FOREST_DEPTH}"
    return TreeModel(
        "random_forest",
        identifier,
        years,
        grid,
        tuple(map(tuple, cuts)),
        tuple(np.log(p / (1 - p)).tolist()),
        domain=domain,
    )


def class_probability(listed: Column, classes: Sequence[int], target: int) -> Column:
    """The probability of a class by its label, not by an assumed place."""
    places = [place for place, code in enumerate(classes) if code == target]
    if len(places) != 1:
        raise ValueError(f"Class {target!r} is not one of the classes, or more than one")
    return F.get(listed, F.lit(places[0]))
