import pytest
from pyspark.sql import functions as F

from labelshift.operators import aggregate, results
from labelshift.plans.identity import configuration_id
from labelshift.sources import loans as sources
from labelshift.sources import sinks
from labelshift.workflows import reports, selection


@pytest.fixture
def cells(spark):
    return spark.createDataFrame(
        [("a", 1, 2004, 0.1), ("a", 1, 2005, 0.3), ("a", 2, 2004, 0.8)],
        "candidate string, horizon int, year int, score double",
    )


def test_horizons_weigh_equally(cells):
    horizons, summary = aggregate.two_stage_means(cells, ["candidate"], ["score"])
    rows = {r.horizon: (r.score, r.n_cells) for r in horizons.collect()}
    assert rows == {1: (pytest.approx(0.2), 2), 2: (pytest.approx(0.8), 1)}
    row = summary.first()
    assert (row.score, row.n_horizons, row.n_cells) == (pytest.approx(0.5), 2, 3)


def test_incomplete_horizons_are_rejected(spark, cells):
    short = cells.unionByName(cells.where("horizon = 1").withColumn("candidate", F.lit("b")))
    with pytest.raises(ValueError, match="lacks horizons"):
        aggregate.two_stage_means(short, ["candidate"], ["score"])
    with pytest.raises(ValueError, match="lacks horizons"):
        aggregate.two_stage_means(cells, ["candidate"], ["score"], [1, 2, 3])
    with pytest.raises(ValueError, match="No cells"):
        aggregate.two_stage_means(cells.where("false"), ["candidate"], ["score"])
    with pytest.raises(ValueError, match="needed for the averages"):
        aggregate.two_stage_means(cells, ["candidate"], ["other"])


def test_null_candidate_drops_from_both_tables(spark, cells):
    with_null = cells.unionByName(cells.withColumn("candidate", F.lit(None).cast("string")))
    horizons, summary = aggregate.two_stage_means(with_null, ["candidate"], ["score"])
    assert horizons.count() == 2 and summary.count() == 1


def test_family_summary_keeps_null_seed(spark):
    rows = [("c", "f", "s", "{}", None, h, 0.1 * h, 0.2, 0.3) for h in (1, 2)]
    frame = spark.createDataFrame(
        rows,
        "configuration_id string, family string, specification string, hyperparameters string,"
        " random_seed int, horizon int, brier_score double, log_loss double, mixture_share double",
    )
    row = aggregate.family_summary(frame)[1].first()
    assert row.selection_brier == pytest.approx(0.15) and row.random_seed is None


def test_share_errors(spark):
    estimates = list(aggregate.SHARE_ESTIMATORS.values())
    rows = [(2005, 2004, 1, 0.1, *[0.1] * 8), (2006, 2004, 2, 0.1, *[0.5] * 8), (2006, 2005, 1, 0.1, *[0.1] * 8)]
    frame = spark.createDataFrame(
        rows, ["train_start", "validation_year", "horizon", "actual_second_share", *estimates]
    )
    _, summary = aggregate.share_error_summary(frame)
    found = {r.estimator: r.selection_absolute_error for r in summary.collect()}
    assert len(found) == 8 and found["raw_mean_probability"] == pytest.approx(0.2)


def test_reliability_pooling_and_metric_summaries(spark):
    table = spark.createDataFrame(
        [(1, 2004, 1, 1, 0.1, 0.1, 0.1, 0.0), (1, 2005, 1, 3, 0.2, 0.4, 0.3, 2 / 3)],
        "horizon int, validation_year int, probability_bin int, n long, min_probability double,"
        " max_probability double, mean_predicted_probability double, observed_second_share double",
    )
    row = aggregate.pooled_reliability(table, ["horizon"]).first()
    assert (row.n, row.n_cells) == (4, 2)
    assert row.mean_predicted_probability == pytest.approx(0.25)
    assert row.observed_second_share == pytest.approx(0.5)
    metrics = spark.createDataFrame(
        [(1, 2004, 10, *[0.1] * 7), (1, 2005, 20, *[0.3] * 7), (2, 2004, 30, *[0.8] * 7)],
        ["horizon", "validation_year", "n", *aggregate.CELL_METRICS],
    )
    horizons, overall = aggregate.reverse_metric_summary(metrics)
    assert horizons.where("horizon = 1").first().brier_score == pytest.approx(0.2)
    assert overall.first().brier_score == pytest.approx(0.5)
    assert aggregate.forward_metric_summary(metrics).first().brier_score == pytest.approx(0.4)


def test_continuity(spark):
    rows = [(2003, None, 0.1, 0.08, 0.18, 0.17), (2004, 0.2, 0.15, 0.12, 0.21, 0.19)]
    annual = spark.createDataFrame(
        rows,
        "year int, actual_second_share double, raw_mean_probability double, raw_hard_share_050 double,"
        " mixture_mean_probability double, mixture_hard_share_050 double",
    )
    found = {r.estimator: r for r in aggregate.boundary_continuity(annual).collect()}
    row = found["mixture_mean_probability"]
    assert row.predicted_2004_minus_2003 == pytest.approx(0.03)
    assert row.predicted_2004_minus_actual == pytest.approx(0.01)
    with pytest.raises(ValueError, match="both needed"):
        aggregate.boundary_continuity(annual.where("year = 2004"))


# -- result tables ---------------------------------------------------------------


@pytest.fixture
def scores(spark):
    return spark.createDataFrame(
        [(2005, 2004, 1, 0.1), (2006, 2004, 2, 0.2), (2006, 2005, 1, 0.3)],
        "train_start int, validation_year int, horizon int, brier_score double",
    )


def test_merged_metrics(scores):
    other = scores.withColumn("brier_score", F.col("brier_score") / 2)
    merged = results.estimator_comparison(scores, "forest", {"logistic": other})
    rows = merged.orderBy("train_start", "validation_year").collect()
    assert [r.forest_minus_logistic_brier for r in rows] == pytest.approx([0.05, 0.1, 0.15])
    with pytest.raises(ValueError, match="more than one row"):
        results.estimator_comparison(scores, "forest", {"logistic": other.unionByName(other)})
    with pytest.raises(ValueError, match="pair up"):
        results.merge_cell_metrics(scores, "brier_score", "a", {"b": (other, "brier_score")}, {})


def test_plan_checks(scores):
    keys = ["train_start", "validation_year"]
    found = scores.where("train_start = 2006").unionByName(scores.where("horizon = 2"))
    status = {
        (r.train_start, r.validation_year): r.status
        for r in results.plan_differences(scores, found, keys).collect()
    }
    assert status == {(2005, 2004): "missing", (2006, 2004): "duplicate", (2006, 2005): "complete"}
    with pytest.raises(ValueError, match="missing, duplicate or unexpected"):
        results.require_plan(scores, found, keys)
    results.require_plan(scores, scores, keys)


def test_table_parity(scores):
    keys = ["train_start", "validation_year"]
    near = scores.withColumn("brier_score", F.col("brier_score") * (1 + 1e-14))
    assert results.table_differences(scores, near, keys, ["brier_score"]).isEmpty()
    far = scores.withColumn(
        "brier_score", F.when(F.col("horizon") == 1, F.col("brier_score")).otherwise(None)
    )
    assert results.table_differences(scores, far, keys, ["brier_score"]).count() == 1


def test_latest_and_survivors(spark):
    table = spark.createDataFrame(
        [("k", 1, 0.5), ("k", 3, 0.7), ("k", 2, 0.6), ("j", 1, None)], "key string, batch int, v double"
    )
    rows = {r.key: (r.batch, r.v) for r in results.latest_by_key(table, ["key"], "batch").collect()}
    assert rows == {"k": (3, 0.7), "j": (1, None)}
    summary = spark.createDataFrame(
        [("a", 1.0, 0.1), ("a", 2.0, 0.05), ("b", 1.0, 0.2), ("c", 1.0, 0.3)],
        "specification string, regularization_c double, selection_brier double",
    )
    kept = results.screen_survivors(summary, "c", 2).collect()
    assert [(r.specification, r.regularization_c) for r in kept] == [("c", 1.0), ("a", 2.0)]
    with pytest.raises(ValueError, match="Incumbent is absent"):
        results.screen_survivors(summary, "z", 2)


def test_stages_must_not_overlap(spark):
    frame = spark.createDataFrame(
        [("s", "linear", "none", "none", 1.0, 2005, 2004, 1, 0.1)],
        "specification string, continuous_form string, interactions string, geography string,"
        " regularization_c double, train_start int, validation_year int, horizon int, brier_score double",
    )
    other = frame.withColumn("regularization_c", F.lit(10.0))
    assert selection.combine_stages(frame, other)["decision"].first().n_cells == 1
    with pytest.raises(ValueError, match="more than one row"):
        selection.combine_stages(frame, frame)
    with pytest.raises(ValueError, match="missing, duplicate or unexpected"):
        selection.combine_stages(frame, other, frame)


def test_metric_records_must_not_share_fields(scores):
    keys = ["train_start", "validation_year", "horizon"]
    with pytest.raises(ValueError, match="both hold"):
        reports.merge_records(keys, [scores, scores])


def test_rows_present(scores):
    assert results.rows_present(scores, {"train_start": 2005}, ["brier_score"])
    assert not results.rows_present(scores, {"train_start": 1999})
    assert not results.rows_present(scores, {"absent": 1})


def test_configuration_id_ignores_parameter_order(spark):
    frame = spark.createDataFrame([({"a": 1.0, "b": 2.0},), ({"b": 2.0, "a": 1.0},)], "p map<string,double>")
    ids = frame.select(
        configuration_id(F.lit("f"), F.lit("s"), F.col("p"), F.lit(17)).alias("id")
    ).distinct().collect()
    assert len(ids) == 1 and ids[0].id.startswith("f__s__")


# -- sources and sinks -------------------------------------------------------------


@pytest.fixture
def stored(spark, records, one_row, tmp_path):
    """Two sources; the second one covers 2005 only and has other names."""
    first = records([one_row(seq_num=1), one_row(asof_date=2006, seq_num=2)])
    second = records([one_row(seq_num=3)])
    root = str(tmp_path / "root")
    for name, frame in (("first", first), ("second", second)):
        frame = frame.withColumns({"source": F.lit(name), "year": F.col("asof_date")})
        sources.convert_to_parquet(frame.drop("asof_date"), root)
    return root


def test_scan_takes_each_year_from_the_preferred_source(spark, stored):
    frame = sources.scan_loans(spark, stored, sources=["second", "first"])
    rows = {(r.source, int(r.year), int(r.seq_num)) for r in frame.collect()}
    assert rows == {("second", 2005, 3), ("first", 2006, 2)}
    only = sources.scan_loans(spark, stored, years=[2005], sources=["first"], columns=["year", "seq_num"])
    assert [r.seq_num for r in only.collect()] == [1]
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "source" in plan.split("PartitionFilters")[1]
    with pytest.raises(ValueError, match="Unknown sources"):
        sources.scan_loans(spark, stored, sources=["third"])
    with pytest.raises(ValueError, match="missing"):
        sources.scan_loans(spark, stored, columns=["year", "absent"])
    loose = sources.scan_loans(spark, stored, columns=["year", "absent"], allow_missing=True)
    assert "absent" not in loose.columns


def test_conversion_skips_finished_partitions(spark, stored):
    before = spark.read.parquet(stored)
    again = before.withColumn("seq_num", F.lit(9))
    assert sources.convert_to_parquet(again, stored).isEmpty()
    assert spark.read.parquet(stored).where("seq_num = 9").isEmpty()


def test_conversion_plan_errors(spark, stored):
    supported = sources.inventory(spark.read.parquet(stored))
    assert sources.conversion_plan(supported, [2005], ["all"]).count() == 2
    with pytest.raises(ValueError, match="Unknown sources"):
        sources.conversion_plan(supported, None, ["x"])
    with pytest.raises(ValueError, match="unavailable"):
        sources.conversion_plan(supported, [2006], ["second"])


def test_upsert_replaces_one_key_and_keeps_the_rest(spark, tmp_path):
    path = str(tmp_path / "cells")
    schema = "train_start int, validation_year int, bin int, value double"
    old = spark.createDataFrame([(2005, 2004, 1, 1.0), (2005, 2003, 1, 2.0), (2006, 2004, 1, 3.0)], schema)
    old.write.parquet(path)
    new = spark.createDataFrame([(2005, 2004, 1, 4.0), (2005, 2004, 2, 5.0)], schema)
    table = sinks.upsert_table(spark, path, new, ["train_start", "validation_year"])
    assert sorted(r.value for r in table.collect()) == [2.0, 3.0, 4.0, 5.0]
    nulls = spark.createDataFrame([(None, 2004, 9, 8.0)], schema)
    for value in (8.0, 8.0):  # a null key replaces the stored null key
        table = sinks.upsert_table(spark, path, nulls, ["train_start", "validation_year"])
        assert sorted(r.value for r in table.collect()) == [2.0, 3.0, 4.0, 5.0, value]
    with pytest.raises(ValueError, match="takes the rows of one key"):
        sinks.upsert_table(spark, path, old, ["train_start", "validation_year"])
    with pytest.raises(ValueError, match="Nothing to put"):
        sinks.upsert_table(spark, path, old.where("false"), ["train_start"])
    with pytest.raises(ValueError, match="No key columns"):
        sinks.replace_rows(old.drop("bin"), new, ["bin"])


def test_absent_table_is_empty_with_its_schema(spark, tmp_path):
    frame = sinks.read_or_empty(spark, str(tmp_path / "none"), "a int, b string")
    assert frame.isEmpty() and frame.columns == ["a", "b"]


def test_forward_summary_holds_forward_cells_only(spark):
    from labelshift.workflows.reports import run_calibration_report

    rows = []
    for fold, start, end, year, horizon, p in (
        ("reverse", 2004, 2007, 2003, 1, 0.2), ("forward", 2000, 2003, 2005, 2, 0.6)
    ):
        for k in range(40):
            q = p + 0.01 * (k % 5)
            rows.append((fold, start, end, year, horizon, 2 if k % 3 == 0 else 1, q, 0.1 * (k % 7)))
    frame = spark.createDataFrame(
        rows,
        "fold_id string, train_start int, train_end int, validation_year int, horizon int, lien_status int,"
        " raw_probability double, log_ratio double",
    )
    tables = run_calibration_report(frame)
    cells = {r.fold_id: r for r in tables["metrics"].collect()}
    forward = tables["forward_summary"].first()
    assert forward.n_cells == 1
    assert abs(forward.brier_score - cells["forward"].brier_score) < 1e-12
    assert [r.horizon for r in tables["horizons"].collect()] == [1]
