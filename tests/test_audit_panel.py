import datetime

import pytest
from pyspark.sql import functions as F

from labelshift.operators import audit, panel, profile
from labelshift.sources import panels


@pytest.fixture
def attrition(spark):
    rows = [
        (2004, 1, 1, 1, 1, 1, 100, 200, 1, 1),
        (2004, 2, 1, 1, 1, 1, 100, 200, 1, 1),
        (2004, 1, 1, 1, 3, 1, 100, 200, 1, 2),
        (2004, 1, 1, 1, 1, 1, 0, 200, 1, 2),
        (2004, 1, 1, 1, 1, 2, 100, 200, 5, 1),
        (2004, 1, 1, 1, 1, 3, 100, 200, 1, 2),
        (2004, 1, 1, 1, 1, 1, 100, 200, 1, None),
    ]
    return spark.createDataFrame(
        rows,
        "year int, action_taken int, loan_purp int, occupancy int, state_code int, county_code int,"
        " app_income int, loan_amt int, loan_type int, lien_status int",
    )


@pytest.fixture
def keys(spark):
    return spark.createDataFrame(
        [(1001, 2004, False), (1003, 2004, True)], "fips long, year int, is_balanced boolean"
    )


def test_cumulative_attrition(attrition, keys):
    cube = audit.match_cube(audit.stage_cube(attrition), keys)
    counts = {r.stage: r.n for r in audit.stage_counts(cube).collect()}
    assert list(counts.values()) and counts == {
        "raw": 7,
        "originated_purchase_owner_occupied": 6,
        "nonmissing_lien_status": 5,
        "valid_geography": 4,
        "positive_income_and_loan_amount": 3,
        "valid_loan_type": 2,
        "matched_fhfa_balanced": 1,
        "finite_model_features": 1,
    }
    row = audit.coverage(cube).first()
    assert (row.n_pre_fhfa, row.n_matched_balanced, row.n_matched_year_specific) == (2, 1, 2)
    classes = {(r.lien_status, r.stage): r.n for r in audit.class_counts(cube).collect()}
    assert classes[(2, "raw")] == 3 and classes[(2, "finite_model_features")] == 1


def test_absent_label_is_a_no_op(attrition, keys):
    cube = audit.match_cube(audit.stage_cube(attrition.drop("lien_status")), keys)
    counts = {r.stage: r.n for r in audit.stage_counts(cube).collect()}
    assert counts["nonmissing_lien_status"] == counts["originated_purchase_owner_occupied"]
    assert audit.class_counts(cube).isEmpty()


def test_merged_batches_equal_one_pass(attrition):
    parts = [attrition.where("lien_status = 1"), attrition.where("lien_status = 2 OR lien_status IS NULL")]
    merged = audit.merge_cubes([audit.stage_cube(part) for part in parts])
    whole = audit.stage_cube(attrition)
    columns = sorted(whole.columns)
    assert sorted(map(str, merged.select(columns).collect())) == sorted(
        map(str, whole.select(columns).collect())
    )


def test_retention(spark):
    counts = spark.createDataFrame(
        [(2000, 0, "raw", 100), (2000, 1, "middle", 80), (2000, 2, "final", 40)],
        "year int, stage_order int, stage string, n long",
    )
    rows = audit.add_retention(counts, ["year"]).orderBy("stage_order").collect()
    assert [r.n_dropped for r in rows] == [0, 20, 40]
    assert [r.retention_from_previous for r in rows] == pytest.approx([1.0, 0.8, 0.5])
    assert [r.retention_from_raw for r in rows] == pytest.approx([1.0, 0.8, 0.4])


def test_county_value_coverage_by_class(attrition, spark):
    held = spark.createDataFrame([(1001, 2004)], "fips long, year int")
    tables = audit.county_value_coverage(attrition, held, [2004])
    row = tables["overall"].first()
    assert (row.n_pre_county_value, row.n_matched_county_value) == (2, 1)
    assert row.county_match_rate_county_value == pytest.approx(0.5)
    rates = {r.lien_status: r.loan_match_rate_county_value for r in tables["classes"].collect()}
    assert rates == {1: 1.0, 2: 0.0}


def test_coverage_keys_and_balanced_panel(spark):
    index = spark.createDataFrame(
        [(1001, 2000, 100.0), (1001, 2001, 101.0), (1003, 2000, 90.0), (1003, 2001, 92.0), (1005, 2001, 80.0)],
        "fips long, year int, hpi double",
    )
    rows = panel.coverage_keys(index, [2000, 2001]).collect()
    assert {r.fips for r in rows if r.is_balanced} == {1001, 1003}
    assert {r.fips for r in rows if r.year == 2001} == {1001, 1003, 1005}
    assert panel.balanced_panel(index, [2000, 2001]).count() == 4


def test_index_comparability(spark):
    index = spark.createDataFrame(
        [(1001, 1990, 100.0, 100.0), (1001, 1991, 110.0, 110.0), (1003, 1990, 200.0, 100.0), (1003, 1991, 240.0, 120.0)],
        "fips long, year int, hpi double, hpi_1990_base double",
    )
    rows = {r.year: r for r in panel.index_comparability(index, [1990, 1991]).collect()}
    assert rows[1990].base_1990_hpi_min == 100.0
    assert rows[1990].native_base_1990_correlation is None
    assert rows[1991].native_base_1990_correlation == pytest.approx(1.0)
    assert rows[1990].native_to_1990_scale_p000 == pytest.approx(1.0)
    assert rows[1991].native_to_1990_scale_p100 == pytest.approx(2.0)


def test_only_complete_years_are_averaged(spark):
    days = [datetime.date(2000 + m // 12, m % 12 + 1, 28) for m in range(14)]
    monthly = spark.createDataFrame(
        [("01001", day.isoformat(), 100_000.0 + i) for i, day in enumerate(days)],
        "fips string, date string, zhvi double",
    )
    row = panel.annualise(panels.monthly_series(monthly)).collect()
    assert len(row) == 1 and (row[0].fips, row[0].year, row[0].n_zhvi_months) == (1001, 2000, 12)
    assert row[0].zhvi == pytest.approx(100_005.5)


@pytest.fixture
def proportional(spark):
    index = spark.createDataFrame(
        [(1001, 2015, 100.0), (1001, 2016, 110.0), (1001, 2017, 120.0), (1003, 2017, 200.0)],
        "fips long, year int, hpi double",
    )
    annual = index.select(
        "fips",
        "year",
        F.when(F.col("fips") == 1001, F.col("hpi") * 2000).otherwise(300_000.0).alias("zhvi"),
        F.lit(12).cast("long").alias("n_zhvi_months"),
    )
    return index, annual


def test_proportional_series_recover_the_scale(proportional):
    overlap = panel.index_value_overlap(*proportional)
    assert overlap.count() == 4
    rows = {r.fips: r for r in panel.estimate_scales(overlap).collect()}
    row = rows[1001]
    for name in panel.SCALE_COLUMNS.values():
        assert row[name] == pytest.approx(2000.0)
    assert row.n_overlap_years == 3 and row.log_rmse_geometric == pytest.approx(0.0, abs=1e-9)
    assert row.unrestricted_log_slope == pytest.approx(1.0)
    assert rows[1003].unrestricted_log_slope is None and rows[1003].log_ratio_time_trend is None


def test_panel_support_and_method(proportional):
    index, annual = proportional
    scales = panel.estimate_scales(panel.index_value_overlap(index, annual))
    built = panel.build_value_panel(index, scales, [2015, 2016, 2017], min_overlap_years=3)
    rows = built.orderBy("year").collect()
    assert [r.county_value for r in rows] == pytest.approx([200_000.0, 220_000.0, 240_000.0])
    with pytest.raises(ValueError, match="No scale is called"):
        panel.build_value_panel(index, scales, [2017], "not-a-method")
    support = panel.support_summary(scales, [1, 3]).orderBy("min_overlap_years").collect()
    assert [r.n_counties for r in support] == [2, 1]
    assert [r.n_counties_anchor_2017 for r in support] == [2, 1]


def test_duplicate_panel_keys_are_rejected(proportional):
    index, annual = proportional
    with pytest.raises(ValueError, match="more than one row"):
        panel.index_value_overlap(index.unionByName(index), annual)


def test_wide_months_are_unpivoted(spark):
    wide = spark.createDataFrame([("01001", 1.0, 2.0)], "fips string, `2000-01-31` double, `2000-02-29` double")
    rows = panels.monthly_series(panels.unpivot_months(wide)).orderBy("date").collect()
    assert [(r.fips, r.date.month, r.zhvi) for r in rows] == [(1001, 1, 1.0), (1001, 2, 2.0)]


def test_source_comparison(spark):
    first = spark.createDataFrame(
        [(1, "01", 1), (1, "01", 2), (2, "NA", 3)], "loan_purp int, state_code string, only_first int"
    )
    second = spark.createDataFrame(
        [(1, "01", 1), (2, "02", 2)], "loan_purpose int, state_code string, only_second int"
    )
    tables = profile.compare_sources(2017, {"first": first, "second": second})
    common = [r.column_name for r in tables["schema"].collect() if r.is_common]
    assert common == ["state_code"]
    row = tables["coverage"].where("source = 'first' AND field = 'state'").first()
    assert (row.n_rows, row.non_null, row.distinct_non_null) == (3, 2, 1)
    assert row.non_null_share == pytest.approx(2 / 3)
    counts = tables["frequencies"].where("source = 'first' AND field = 'state'").collect()
    assert [(r.value, r.n) for r in counts] == [("01", 2)]
