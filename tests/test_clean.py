import math

import pytest

from labelshift.domain import Domain
from labelshift.operators.clean import (
    clean_loans,
    geographic_support,
    pin_levels,
)
from labelshift.sources import loans as sources


@pytest.fixture
def panel(spark):
    return spark.createDataFrame(
        [(6037, 2005, 200.0, 450_000.0)], "fips long, year int, hpi double, county_value double"
    )


def test_valid_record_gets_features(records, one_row, panel):
    row = clean_loans(records([one_row()]), panel).first()
    assert row.fips == 6037
    assert row.log_lti == pytest.approx(math.log(3.0))
    assert row.log_county_value_to_loan == pytest.approx(math.log(1.5))
    assert not row.has_edit_status and not row.loan_below_10k
    assert (row.edit_status, row.loan_type, row.lien_status) == (0, 1, 1)
    assert (row.resp_id, row.seq_num) == (111.0, 1)


def test_restricted_features_need_no_county_match(records, one_row, panel):
    raw = records([one_row(county_code=99)])
    assert clean_loans(raw, panel).count() == 0
    frame = clean_loans(raw)
    assert frame.first().fips == 6099
    assert "log_county_value_to_loan" not in frame.columns


def test_edit_and_small_loan_flags(records, one_row, panel):
    row = clean_loans(records([one_row(lien_status=2, edit_status=5.0, loan_amt=5.0)]), panel).first()
    assert row.has_edit_status and row.edit_status == 5 and row.loan_below_10k


REJECTED = (
    {"action_taken": 2},
    {"loan_purp": 3},
    {"occupancy": 2},
    {"lien_status": None},
    {"state_code": 3},
    {"state_code": 0},
    {"county_code": 0},
    {"app_income": float("nan")},
    {"loan_amt": None},
    {"app_income": 0.5},
    {"loan_type": 5.0},
    {"loan_type": 4.5},
)


def test_every_rejection_drops_only_its_record(records, one_row):
    rows = [one_row(seq_num=i + 10, **change) for i, change in enumerate(REJECTED)]
    kept = clean_loans(records([one_row(), *rows])).select("seq_num").collect()
    assert [row.seq_num for row in kept] == [1]


def test_fractional_loan_type_is_truncated_after_the_test(records, one_row):
    assert clean_loans(records([one_row(loan_type=1.5)])).first().loan_type == 1


def test_absent_label_is_not_required(records, one_row):
    frame = clean_loans(records([one_row()]).drop("lien_status"))
    assert frame.count() == 1 and "lien_status" not in frame.columns


def test_unlabelled_period_keeps_its_records(records, one_row):
    rows = [one_row(asof_date=2003, lien_status=None), one_row(lien_status=None, seq_num=2)]
    kept = clean_loans(records(rows), unlabelled_before=2004)
    assert [row.year for row in kept.collect()] == [2003]


def test_unknown_level_becomes_null_and_row_stays(spark):
    frame = spark.createDataFrame([(2, 3), (9, 12)], "loan_type int, purchaser_type int")
    rows = {tuple(row) for row in pin_levels(frame).collect()}
    assert rows == {(2, 3), (None, None)}
    assert {tuple(r) for r in pin_levels(frame, ["loan_type"]).collect()} == {(2, 3), (None, 12)}


def test_provider_text_columns_are_coerced(spark):
    raw = spark.createDataFrame(
        [("2015", "06", "037", "300", "1e2", "NA", "12x")],
        "activity_year string, state_code string, county_code string, loan_amount_000s string,"
        " applicant_income_000s string, edit_status string, purchaser_type string",
    )
    row = sources.numeric_columns(sources.canonical_columns(raw)).first()
    assert (row.year, row.state_code, row.county_code) == (2015.0, 6.0, 37.0)
    assert (row.loan_amt, row.app_income, row.edit_status) == (300.0, 100.0, None)
    assert row.purchaser_type is None


def test_two_names_for_one_column_are_rejected(spark):
    raw = spark.createDataFrame([(2005, 2005)], "asof_date int, as_of_year int")
    with pytest.raises(ValueError, match="both provide"):
        sources.canonical_columns(raw)


def test_label_policies(spark):
    frame = spark.createDataFrame(
        [(2003, 1), (2005, 2), (2006, None)], "year int, lien_status int"
    )
    allowed = {tuple(r) for r in sources.apply_label_policy(frame, "allow").collect()}
    assert allowed == {(2003, None), (2005, 2), (2006, None)}
    assert "lien_status" not in sources.apply_label_policy(frame, "drop").columns
    with pytest.raises(ValueError, match="2006"):
        sources.apply_label_policy(frame, "require")
    with pytest.raises(ValueError, match="missing lien_status"):
        sources.apply_label_policy(frame.drop("lien_status"), "require")
    with pytest.raises(ValueError, match="Unknown label_policy"):
        sources.apply_label_policy(frame, "maybe")


def test_geographic_support_keeps_missing_codes(spark):
    frame = spark.createDataFrame([(2004, 6), (2004, 6), (2004, None)], "year int, state_code int")
    rows = {(r.geography, r.level): (r.n, r.share) for r in geographic_support(frame, Domain()).collect()}
    assert rows[("state", "6")] == (2, pytest.approx(2 / 3))
    assert rows[("region", "west")][0] == 2
    assert rows[("state", None)][0] == rows[("region", None)][0] == 1
