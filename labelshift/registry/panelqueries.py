"""Queries of panels, audits, profiles and coverage joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, clean, panel, profile
from . import inputs
from .book import query, r
from .inputs import DOMAIN, PANEL_YEARS, loans

STAGE_TESTS = {
    "raw": "TRUE",
    "originated_purchase_owner_occupied": "t1",
    "nonmissing_lien_status": "t1 AND t2",
    "valid_geography": "t1 AND t2 AND t3",
    "positive_income_and_loan_amount": "t1 AND t2 AND t3 AND t4",
    "valid_loan_type": "t1 AND t2 AND t3 AND t4 AND t5",
    "matched_fhfa_balanced": "t1 AND t2 AND t3 AND t4 AND t5 AND in_balanced",
    "finite_model_features": "t1 AND t2 AND t3 AND t4 AND t5 AND in_balanced",
}


def stage_sql(keys: str, table: str, n_stages: int = 8) -> str:
    """Long stage counts with retention, from a table holding the tests."""
    names = list(STAGE_TESTS)[:n_stages]
    parts = " UNION ALL ".join(
        f"SELECT {keys}, {i} AS stage_order, '{name}' AS stage, count(*) FILTER ({STAGE_TESTS[name]}) AS n"
        f" FROM {table} GROUP BY {keys}"
        for i, name in enumerate(names)
    )
    return f"""SELECT {keys}, stage_order, stage, n, COALESCE(prev - n, 0)::BIGINT AS n_dropped,
    round(CASE WHEN prev > 0 THEN n / prev::DOUBLE ELSE 1.0 END, 6) AS retention_from_previous,
    round(CASE WHEN raw > 0 THEN n / raw::DOUBLE END, 6) AS retention_from_raw
    FROM (SELECT *, lag(n) OVER w AS prev, first_value(n) OVER w AS raw FROM ({parts}) s
      WINDOW w AS (PARTITION BY {keys} ORDER BY stage_order)) g"""


COVERAGE = """SELECT year, n1 AS n_pre_fhfa, n2 AS n_matched_balanced, n3 AS n_matched_year_specific,
    c1 AS n_counties_pre_fhfa, c2 AS n_counties_matched_balanced, c3 AS n_counties_matched_year_specific,
    round(n2 / n1::DOUBLE, 6) AS loan_match_rate_balanced, round(c2 / c1::DOUBLE, 6) AS county_match_rate_balanced,
    round(n3 / n1::DOUBLE, 6) AS loan_match_rate_year_specific,
    round(c3 / c1::DOUBLE, 6) AS county_match_rate_year_specific
    FROM (SELECT year, count(*) AS n1, count(*) FILTER (in_balanced) AS n2, count(*) FILTER (in_year) AS n3,
      count(DISTINCT county) AS c1, count(DISTINCT county) FILTER (in_balanced) AS c2,
      count(DISTINCT county) FILTER (in_year) AS c3
      FROM matched WHERE t1 AND t2 AND t3 AND t4 AND t5 GROUP BY year) g"""


def matched_cube(spark, sf):
    keys = panel.coverage_keys(inputs.county_index(spark, sf), PANEL_YEARS)
    return audit.match_cube(audit.stage_cube(loans(spark, sf), DOMAIN), keys)


@query("attrition_by_year", stage_sql("year", "stage_loans", 6))
def attrition(spark, sf):
    """Flagship: stage attrition with retention, one scan of the records."""
    return audit.stage_counts(audit.stage_cube(loans(spark, sf), DOMAIN))


@query("jon1_records_with_county_value", f"SELECT seq_num, fips, year, {r('hpi', 'log_county_value_to_loan')} FROM core")
def _(spark, sf):
    return inputs.core(spark, sf).select("seq_num", "fips", "year", "hpi", "log_county_value_to_loan")


@query(
    "jon2_index_value_overlap",
    f"SELECT fips, year, {r('hpi', 'zhvi', 'log_ratio')}, n_zhvi_months FROM overlap",
)
def _(spark, sf):
    annual = panel.annualise(inputs.county_monthly(spark, sf))
    overlap = panel.index_value_overlap(inputs.county_index(spark, sf), annual)
    return overlap.select("fips", "year", "hpi", "zhvi", "log_ratio", "n_zhvi_months")


def scales(spark, sf, validate=False):
    annual = panel.annualise(inputs.county_monthly(spark, sf))
    overlap = panel.index_value_overlap(inputs.county_index(spark, sf), annual, validate=validate)
    return panel.estimate_scales(overlap, anchor_year=1998)


@query(
    "jon3_panel_with_scale",
    f"""SELECT h.fips, h.year, s.n_overlap_years, round(h.hpi * s.scale_ols_origin, 6) AS county_value,
    'ols_origin' AS scaling_method FROM hpi h JOIN scales s ON h.fips = s.fips
    WHERE h.year BETWEEN 1995 AND 2001 AND h.hpi > 0 AND s.n_overlap_years >= 3""",
)
def _(spark, sf):
    built = panel.build_value_panel(
        inputs.county_index(spark, sf), scales(spark, sf), PANEL_YEARS, "ols_origin", 3
    )
    return built.select("fips", "year", "n_overlap_years", "county_value", "scaling_method")


@query(
    "jon4_county_membership",
    "SELECT year, in_year, in_balanced, count(*) AS n FROM matched GROUP BY ALL",
)
def _(spark, sf):
    return matched_cube(spark, sf).groupBy("year", "in_year", "in_balanced").agg(
        F.sum("raw").alias("n")
    )


@query("agg1_stage_counts", stage_sql("year", "matched"))
def _(spark, sf):
    return audit.stage_counts(matched_cube(spark, sf))


@query("agg2_class_stage_counts", stage_sql("year, lien_status", "matched"))
def _(spark, sf):
    return audit.class_counts(matched_cube(spark, sf), DOMAIN)


@query("agg3_merged_batches", COVERAGE)
def _(spark, sf):
    frame = loans(spark, sf)
    batches = [frame.where(F.col("agency_code") == code) for code in (1, 2, 3)]
    cube = audit.merge_cubes([audit.stage_cube(batch, DOMAIN) for batch in batches])
    keys = panel.coverage_keys(inputs.county_index(spark, sf), PANEL_YEARS)
    return audit.coverage(audit.match_cube(cube, keys))


@query("agg4_coverage", COVERAGE)
def _(spark, sf):
    return audit.coverage(matched_cube(spark, sf))


@query(
    "agg5_sample_audit",
    f"""SELECT 'stages' AS report, year, stage AS item, n FROM ({stage_sql('year', 'matched')}) a
    UNION ALL SELECT 'classes', year, stage || '_' || lien_status, n
    FROM ({stage_sql('year, lien_status', 'matched')}) b
    UNION ALL SELECT 'coverage', year, 'n_counties_pre_fhfa', n_counties_pre_fhfa FROM ({COVERAGE}) c
    UNION ALL SELECT 'index_levels', year, 'n_balanced_counties', count(DISTINCT fips) FROM coverage_keys
    WHERE is_balanced GROUP BY year""",
)
def _(spark, sf):
    reports = audit.run_sample_audit(
        loans(spark, sf), inputs.county_index(spark, sf), PANEL_YEARS, domain=DOMAIN
    )

    def part(name, item, n):
        return reports[name].select(F.lit(name).alias("report"), "year", item.alias("item"), n.alias("n"))

    return (
        part("stages", F.col("stage"), F.col("n"))
        .unionByName(
            part("classes", F.concat_ws("_", "stage", F.col("lien_status")), F.col("n"))
        )
        .unionByName(
            part("coverage", F.lit("n_counties_pre_fhfa"), F.col("n_counties_pre_fhfa"))
        )
        .unionByName(
            part("index_levels", F.lit("n_balanced_counties"), F.col("n_balanced_counties"))
        )
    )


PANEL_MATCH = """SELECT l.*, p.fips IS NOT NULL AS held FROM stage_loans l
  LEFT JOIN (SELECT DISTINCT fips, year FROM panel) p ON p.fips = l.county AND p.year = l.year
  WHERE t1 AND t2 AND t3 AND t4 AND t5"""


@query(
    "agg6_county_value_coverage",
    """SELECT year, n1 AS n_pre_county_value, n2 AS n_matched_county_value, c1 AS n_counties_pre_county_value,
    c2 AS n_counties_matched_county_value, round(n2 / n1::DOUBLE, 6) AS loan_match_rate_county_value,
    round(c2 / c1::DOUBLE, 6) AS county_match_rate_county_value
    FROM (SELECT year, count(*) AS n1, count(*) FILTER (held) AS n2, count(DISTINCT county) AS c1,
      count(DISTINCT county) FILTER (held) AS c2 FROM panel_match GROUP BY year) g""",
    panel_match=PANEL_MATCH,
)
def _(spark, sf):
    return audit.county_value_coverage(
        loans(spark, sf), inputs.value_panel(spark, sf), PANEL_YEARS, domain=DOMAIN
    )["overall"]


@query(
    "jon13_class_match_rates",
    """SELECT year, lien_status, count(*) AS n_pre_county_value, count(*) FILTER (held) AS n_matched_county_value,
    round(count(*) FILTER (held) / count(*)::DOUBLE, 6) AS loan_match_rate_county_value
    FROM panel_match GROUP BY 1, 2""",
    panel_match=PANEL_MATCH,
)
def _(spark, sf):
    return audit.county_value_coverage(
        loans(spark, sf), inputs.value_panel(spark, sf), PANEL_YEARS, domain=DOMAIN
    )["classes"]


@query("agg7_coverage_keys", "SELECT fips, year, is_balanced FROM coverage_keys")
def _(spark, sf):
    return panel.coverage_keys(inputs.county_index(spark, sf), PANEL_YEARS)


@query(
    "agg8_index_levels",
    """SELECT year, count(DISTINCT fips) AS n_balanced_counties, round(min(hpi), 6) AS native_hpi_min,
    round(median(hpi), 6) AS native_hpi_median, round(max(hpi), 6) AS native_hpi_max,
    round(min(hpi_1990_base), 6) AS base_1990_hpi_min, round(median(hpi_1990_base), 6) AS base_1990_hpi_median,
    round(max(hpi_1990_base), 6) AS base_1990_hpi_max,
    round(CASE WHEN min(hpi) < max(hpi) AND min(hpi_1990_base) < max(hpi_1990_base)
      THEN corr(hpi, hpi_1990_base) END, 6) AS native_base_1990_correlation,
    round(min(p000), 6) AS native_to_1990_scale_p000, round(min(p010), 6) AS native_to_1990_scale_p010,
    round(min(p050), 6) AS native_to_1990_scale_p050, round(min(p090), 6) AS native_to_1990_scale_p090,
    round(min(p100), 6) AS native_to_1990_scale_p100
    FROM balanced CROSS JOIN (SELECT quantile_cont(s, 0.0) AS p000, quantile_cont(s, 0.1) AS p010,
      quantile_cont(s, 0.5) AS p050, quantile_cont(s, 0.9) AS p090, quantile_cont(s, 1.0) AS p100
      FROM (SELECT fips, arg_min(hpi / hpi_1990_base, year) AS s FROM balanced GROUP BY fips) f) q
    GROUP BY year""",
    balanced="""SELECT h.* FROM hpi h WHERE h.year BETWEEN 1995 AND 2001
      AND h.fips IN (SELECT fips FROM coverage_keys WHERE is_balanced)""",
)
def _(spark, sf):
    return panel.index_comparability(inputs.county_index(spark, sf), PANEL_YEARS)


@query(
    "agg9_balanced_panel",
    f"""SELECT fips, year, {r('hpi')} FROM hpi WHERE year BETWEEN 1995 AND 2001
    AND fips IN (SELECT fips FROM coverage_keys WHERE is_balanced)""",
)
def _(spark, sf):
    return panel.balanced_panel(inputs.county_index(spark, sf), PANEL_YEARS)


@query("agg10_annual_values", f"SELECT fips, year, {r('zhvi')}, n_zhvi_months FROM annual")
def _(spark, sf):
    return panel.annualise(inputs.county_monthly(spark, sf))


@query(
    "agg11_county_scales",
    f"""SELECT fips, n_overlap_years, first_overlap_year, last_overlap_year, {r(
        'scale_geometric', 'scale_ols_origin', 'scale_median_log_ratio', 'scale_anchor_2017',
        'log_rmse_geometric', 'log_ratio_sd', 'log_ratio_time_trend', 'unrestricted_log_slope')} FROM scales""",
)
def _(spark, sf):
    return scales(spark, sf)


@query("agg12_value_panel", f"SELECT fips, year, {r('hpi', 'county_value')} FROM panel")
def _(spark, sf):
    return inputs.value_panel(spark, sf)


@query(
    "agg13_support_summary",
    """SELECT CAST(m AS INTEGER) AS min_overlap_years, count(*) FILTER (n_overlap_years >= m) AS n_counties,
    count(*) FILTER (n_overlap_years >= m AND scale_geometric IS NOT NULL) AS n_counties_geometric,
    count(*) FILTER (n_overlap_years >= m AND scale_ols_origin IS NOT NULL) AS n_counties_ols_origin,
    count(*) FILTER (n_overlap_years >= m AND scale_median_log_ratio IS NOT NULL) AS n_counties_median_log_ratio,
    count(*) FILTER (n_overlap_years >= m AND scale_anchor_2017 IS NOT NULL) AS n_counties_anchor_2017
    FROM scales CROSS JOIN (VALUES (1), (3), (5)) v(m) GROUP BY m""",
)
def _(spark, sf):
    return panel.support_summary(scales(spark, sf))


def sources(spark, sf):
    return {"first": inputs.text_loans(spark, sf), "second": inputs.second_source(spark, sf)}


FIELDS = {
    # field: first column, first value, second column, second value, counted
    "year": ("as_of_year", "year::VARCHAR", "activity_year", "year::VARCHAR", True),
    "loan_type": ("loan_type", "loan_type::VARCHAR", "loan_type", "loan_type::VARCHAR", True),
    "loan_purpose": ("loan_purpose", "loan_purp::VARCHAR", "loan_purpose", "loan_purp::VARCHAR", True),
    "occupancy": ("owner_occupancy", "occupancy::VARCHAR", "occupancy_type", "occupancy::VARCHAR", True),
    "loan_amount": ("loan_amount_000s", "''", "loan_amount_000s", "''", False),
    "action_taken": ("action_taken", "action_taken::VARCHAR", "action_taken", "action_taken::VARCHAR", True),
    "state": ("state_code", "lpad(state_code::VARCHAR, 2, '0')", "state_code", "lpad(state_code::VARCHAR, 2, '0')", True),
    "county": (
        "county_code",
        "CASE WHEN county_code > 0 THEN lpad(county_code::VARCHAR, 3, '0') END",
        "county_code",
        "county_code::VARCHAR",
        True,
    ),
    "purchaser_type": ("purchaser_type", "purchaser_type::VARCHAR", "purchaser_type", "purchaser_type::VARCHAR", True),
    "lien_status": ("lien_status", "lien_status::VARCHAR", "lien_status", "lien_status::VARCHAR", True),
    "income": ("applicant_income_000s", "''", None, None, False),
}
VALUES = " UNION ALL ".join(
    f"SELECT '{source}' AS source, '{field}' AS field, '{entry[at]}' AS column_name, {entry[at + 1]} AS value,"
    f" {entry[4]} AS counted FROM loans WHERE year = 1998"
    for field, entry in FIELDS.items()
    for source, at in (("first", 0), ("second", 2))
    if entry[at] is not None
)


@query(
    "agg14_source_profile",
    """SELECT source, field, column_name, 1998 AS year, count(*) AS n_rows, count(value) AS non_null,
    round(count(value) / count(*)::DOUBLE, 6) AS non_null_share,
    CASE WHEN counted THEN count(DISTINCT value) END AS distinct_non_null
    FROM field_values GROUP BY source, field, column_name, counted""",
    field_values=VALUES,
)
def _(spark, sf):
    return profile.compare_sources(1998, sources(spark, sf))["coverage"]


@query(
    "agg14_value_frequencies",
    """SELECT source, field, 1998 AS year, value, count(*) AS n FROM field_values
    WHERE counted AND value IS NOT NULL AND field <> 'county' GROUP BY source, field, value""",
    field_values=VALUES,
)
def _(spark, sf):
    return profile.compare_sources(1998, sources(spark, sf))["frequencies"]


@query(
    "agg15_schema_comparison",
    """SELECT column_name, string_agg(source, ',' ORDER BY source) AS sources, count(*) AS n_sources,
    count(*) = 2 AS is_common, count(*) = 2 AND count(DISTINCT kind) > 1 AS type_differs, any_value(n) AS n_rows
    FROM (VALUES ('first', 'as_of_year', 's'), ('first', 'action_taken', 's'), ('first', 'loan_purpose', 's'),
      ('first', 'owner_occupancy', 's'), ('first', 'agency_code', 'i'), ('first', 'loan_type', 's'),
      ('first', 'loan_amount_000s', 's'), ('first', 'applicant_income_000s', 's'),
      ('first', 'purchaser_type', 's'), ('first', 'edit_status', 's'), ('first', 'state_code', 's'),
      ('first', 'county_code', 's'), ('first', 'lien_status', 's'), ('first', 'respondent_id', 'l'),
      ('first', 'sequence_number', 'l'), ('second', 'activity_year', 'i'), ('second', 'action_taken', 'i'),
      ('second', 'loan_purpose', 's'), ('second', 'occupancy_type', 'i'), ('second', 'loan_type', 'l'),
      ('second', 'loan_amount_000s', 'd'), ('second', 'state_code', 's'), ('second', 'county_code', 'i'),
      ('second', 'purchaser_type', 'i'), ('second', 'lien_status', 'i'), ('second', 'private_flag', 'l'))
      v(source, column_name, kind) CROSS JOIN (SELECT count(*) AS n FROM loans) c GROUP BY column_name""",
)
def _(spark, sf):
    frames = sources(spark, sf)
    n_rows = frames["second"].agg(F.count(F.lit(1))).scalar()
    return profile.compare_schemas(profile.schema_table(frames)).withColumn("n_rows", n_rows)


@query(
    "agg16_training_counts",
    """SELECT year, count(*) AS n_training, count(*) FILTER (lien_status = 1) AS n_first,
    count(*) FILTER (lien_status = 2) AS n_second, 0::BIGINT AS n_unknown FROM clean GROUP BY year""",
)
def _(spark, sf):
    from ..operators.weights import training_counts

    return training_counts(inputs.restricted(spark, sf), ["year"], DOMAIN)


REGION_ROWS = """SELECT year, 'state' AS geography, state_code::VARCHAR AS level FROM clean
    UNION ALL SELECT year, 'region', CASE
      WHEN state_code IN (9,23,25,33,34,36,42,44,50) THEN 'northeast'
      WHEN state_code IN (17,18,19,20,26,27,29,31,38,39,46,55) THEN 'midwest'
      WHEN state_code IN (1,5,10,11,12,13,21,22,24,28,37,40,45,47,48,51,54) THEN 'south'
      WHEN state_code IN (2,4,6,8,15,16,30,32,35,41,49,53,56) THEN 'west' END FROM clean"""


@query(
    "agg17_geographic_support",
    """SELECT g.year, geography, level, count(*) AS n, round(count(*) / any_value(t.n)::DOUBLE, 6) AS share
    FROM region_rows g JOIN (SELECT year, count(*) AS n FROM clean GROUP BY year) t ON g.year = t.year
    GROUP BY g.year, geography, level""",
    region_rows=REGION_ROWS,
)
def _(spark, sf):
    return clean.geographic_support(inputs.restricted(spark, sf), DOMAIN)


@query(
    "agg34_set_algebra",
    """SELECT 'both' AS part, year FROM (SELECT DISTINCT year FROM loans INTERSECT SELECT DISTINCT year FROM hpi) a
    UNION ALL SELECT 'index_only', year FROM (SELECT DISTINCT year FROM hpi EXCEPT SELECT DISTINCT year FROM loans) b
    UNION ALL SELECT 'loans_only', year FROM (SELECT DISTINCT year FROM loans EXCEPT SELECT DISTINCT year FROM annual) c""",
)
def _(spark, sf):
    recorded = loans(spark, sf).select("year").distinct()
    index = inputs.county_index(spark, sf).select("year").distinct()
    annual = panel.annualise(inputs.county_monthly(spark, sf)).select("year").distinct()
    parts = {
        "both": recorded.intersect(index),
        "index_only": index.subtract(recorded),
        "loans_only": recorded.subtract(annual),
    }
    result = None
    for name, frame in parts.items():
        part = frame.select(F.lit(name).alias("part"), "year")
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "win1_retention",
    stage_sql("year, loan_type", "stage_loans", 6),
)
def _(spark, sf):
    frame = loans(spark, sf)
    masks = audit.stage_masks(frame, DOMAIN)
    keys = ["year", "loan_type"]
    wide = frame.groupBy(*keys).agg(*[F.count_if(m).alias(s) for s, m in masks.items()])
    return audit.add_retention(audit.long_stages(wide, keys, list(masks)), keys)
