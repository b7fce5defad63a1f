"""Queries of sources, sinks, projections, filters and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..domain import Domain
from ..functions.expressions import is_close
from ..operators import clean
from ..operators.audit import stage_cube
from ..operators.features import input_violations
from ..operators.metrics import cell_violations, probability_violations
from ..operators.profile import present_token
from ..plans.identity import configuration_id, with_identity
from ..sources import loans as source_loans
from ..sources import panels, sinks
from ..models.logistic import hard_class
from . import inputs
from .book import query, r, workspace
from .inputs import DOMAIN, loans, positive, table, text_loans
from .sqlparts import REGION_CASE

TEXT = """
SELECT year, loan_purp, occupancy, seq_num, resp_id, loan_type, state_code, purchaser_type, lien_status,
  CASE WHEN seq_num % 11 = 0 THEN NULL ELSE round(loan_amt, 3) END AS loan_amt,
  CASE WHEN app_income < 1 THEN NULL ELSE round(app_income, 3) END AS app_income,
  edit_status, CASE WHEN county_code = 0 THEN NULL ELSE county_code END AS county_code
FROM loans"""
YEAR_COUNTS = "SELECT year, lien_status, count(*) AS n FROM clean GROUP BY 1, 2"


def year_counts(spark, sf):
    return inputs.restricted(spark, sf).groupBy("year", "lien_status").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "src1_annual_scan",
    f"""SELECT CAST(year AS DOUBLE) AS year, {r('loan_type', 'loan_amt', 'app_income', 'state_code')},
    CAST(lien_status AS DOUBLE) AS lien_status, resp_id, seq_num FROM texts WHERE year IN (1997, 1998)""",
    texts=TEXT,
)
def _(spark, sf):
    # The table on disk is partitioned by year, and each year comes from the preferred source.
    path = f"{workspace(spark)}/annual"
    stored = text_loans(spark, sf).withColumn("year", F.col("as_of_year").cast("int")).drop("as_of_year")
    source_loans.convert_to_parquet(
        stored.withColumn("source", F.lit("first")).unionByName(
            stored.where("year = 1998").withColumn("source", F.lit("second"))
        ),
        path,
    )
    wanted = (
        "year", "loan_type", "loan_amt", "app_income", "state_code", "lien_status", "resp_id", "seq_num",
    )
    return source_loans.scan_loans(
        spark, path, years=(1997, 1998), sources=("second", "first"), columns=wanted, domain=DOMAIN
    ).select(F.col("year").cast("double").alias("year"), *wanted[1:])


@query(
    "src2_legacy_scan",
    """SELECT year, count(*) AS n_rows, count(lien_status) AS n_label, count(edit_status) AS n_edit,
    sum(CASE WHEN county_code >= 1 THEN 1 ELSE 0 END)::BIGINT AS n_county FROM loans GROUP BY year""",
)
def _(spark, sf):
    return source_loans.legacy_counts(loans(spark, sf))


@query(
    "src3_selection_years",
    f"""SELECT year, lien_status, {r('log_lti')}, purchaser_type, loan_type, state_code FROM clean
    WHERE year IN (1996, 1997, 1998, 1999)""",
)
def _(spark, sf):
    path = f"{workspace(spark)}/extract"
    sinks.write_selection_extract(
        inputs.restricted(spark, sf), path, feature_set="restricted", domain=DOMAIN
    )
    return sinks.load_selection_years(spark, path, range(1996, 2000), "restricted", DOMAIN)


@query("src4_index_panel", f"SELECT fips, year, {r('hpi', 'hpi_1990_base')} FROM hpi")
def _(spark, sf):
    path = f"{workspace(spark)}/index"
    inputs.county_index(spark, sf).write.parquet(path)
    return panels.read_index_panel(spark, path)


@query("src5_monthly_series", f"SELECT fips, date, {r('zhvi')} FROM monthly")
def _(spark, sf):
    text_keys = inputs.county_monthly(spark, sf).withColumn(
        "fips", F.lpad(F.col("fips").cast("string"), 5, "0")
    )
    path = f"{workspace(spark)}/monthly"
    older = text_keys.withColumns({"zhvi": F.col("zhvi") * 2, "vintage": F.lit("2016-12")})
    older.unionByName(text_keys.withColumn("vintage", F.lit("2017-03"))).write.partitionBy("vintage").parquet(path)
    return panels.read_monthly_series(spark, path, "2017-03")


@query(
    "src6_reference_table",
    """SELECT n_nationkey, n_name, r_name, count(c_custkey) AS n_customers FROM nation
    JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey
    GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    path = f"{workspace(spark)}/reference"
    table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", "n_name", "r_name").write.option("header", "true").csv(path)
    reference = panels.read_reference_csv(
        spark, path, "n_nationkey int, n_name string, r_name string"
    )
    counts = table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n_customers")
    )
    joined = reference.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select(
        "n_nationkey", "n_name", "r_name", F.coalesce("n_customers", F.lit(0)).alias("n_customers")
    )


def two_sources(spark, sf):
    frame = loans(spark, sf)
    source = F.when((F.col("seq_num") % 3 == 0) & (F.col("year") > 1995), "second").otherwise("first")
    return frame.withColumn("source", source)


@query(
    "src7_conversion",
    """SELECT source, year, count(*) AS n_rows FROM (SELECT year,
    CASE WHEN seq_num % 3 = 0 AND year > 1995 THEN 'second' ELSE 'first' END AS source FROM loans) g
    GROUP BY 1, 2""",
)
def _(spark, sf):
    path = f"{workspace(spark)}/converted"
    incoming = two_sources(spark, sf)
    source_loans.convert_to_parquet(incoming.where("year < 1998"), path)
    source_loans.convert_to_parquet(incoming, path)
    return source_loans.inventory(spark.read.parquet(path))


@query(
    "src8_supported_plan",
    """SELECT 'second' AS source, year, count(*) AS n_rows FROM loans
    WHERE seq_num % 3 = 0 AND year IN (1996, 1999) GROUP BY year""",
)
def _(spark, sf):
    supported = source_loans.inventory(two_sources(spark, sf)).persist()
    return source_loans.conversion_plan(supported, [1996, 1999], ["second"])


@query(
    "snk1_selection_extract",
    """SELECT year, count(*) AS n, count(*) FILTER (lien_status = 1) AS n_first,
    count(*) FILTER (lien_status = 2) AS n_second, 'core' AS feature_set FROM core GROUP BY year""",
)
def _(spark, sf):
    path = f"{workspace(spark)}/core"
    return sinks.write_selection_extract(inputs.core(spark, sf), path, domain=DOMAIN)


@query("snk2_result_tables", YEAR_COUNTS)
def _(spark, sf):
    paths = sinks.write_tables({"classes": year_counts(spark, sf)}, workspace(spark))
    return spark.read.parquet(paths[0])


@query(
    "snk3_keyed_upsert",
    """SELECT year, lien_status, CASE WHEN year = 1998 THEN -n ELSE n END AS n FROM counts""",
    counts=YEAR_COUNTS,
)
def _(spark, sf):
    path = f"{workspace(spark)}/stored"
    counts = year_counts(spark, sf)
    counts.write.parquet(path)
    new = counts.where("year = 1998").withColumn("n", -F.col("n"))
    return sinks.upsert_table(spark, path, new, ["year"])


@query(
    "snk4_append_rows",
    "SELECT year, lien_status, n FROM counts UNION ALL SELECT year, lien_status, n + 1 AS n FROM counts",
    counts=YEAR_COUNTS,
)
def _(spark, sf):
    counts = year_counts(spark, sf)
    return sinks.append_rows(counts, counts.withColumn("n", F.col("n") + 1))


@query("snk5_table_or_empty", YEAR_COUNTS)
def _(spark, sf):
    counts = year_counts(spark, sf)
    stored = sinks.read_or_empty(spark, f"{workspace(spark)}/absent", counts.schema)
    return sinks.append_rows(stored, counts)


@query(
    "snk6_json_report",
    """SELECT year, '{"lien_status":' || lien_status || ',"n":' || n || ',"year":' || year || '}' AS document
    FROM counts""",
    counts=YEAR_COUNTS,
)
def _(spark, sf):
    return sinks.report_json(year_counts(spark, sf), ["year"])


@query(
    "snk8_identities",
    """SELECT specification, label AS c_label, train_start, n,
    'logistic__' || specification || '__c_' || label || '__train_' || train_start || '_' || train_end AS model_id,
    'models/logistic__' || specification || '__c_' || label || '__train_' || train_start || '_' || train_end
      AS model_path,
    'logistic__' || specification || '__' || substr(sha256('{"family":"logistic","hyperparameters":{"C":'
      || number || '},"random_seed":null,"specification":"' || specification || '"}'), 1, 12)
      AS configuration_id
    FROM (SELECT specification, train_start, train_end, sum(n)::BIGINT AS n,
        CASE regularization_c WHEN 0.01 THEN '0p01' WHEN 0.1 THEN '0p1' ELSE '1' END AS label,
        CASE regularization_c WHEN 0.01 THEN '0.01' WHEN 0.1 THEN '0.1' ELSE '1.0' END AS number
      FROM cells GROUP BY ALL) g""",
)
def _(spark, sf):
    plan = (
        inputs.cells(spark, sf)
        .groupBy("specification", "regularization_c", "train_start", "train_end")
        .agg(F.sum("n").alias("n"))
    )
    parameters = F.create_map(F.lit("C"), F.col("regularization_c"))
    identified = with_identity(plan, "logistic", "models")
    return identified.select(
        "specification",
        F.regexp_extract("model_id", r"__c_([0-9p]+)__", 1).alias("c_label"),
        "train_start",
        "n",
        "model_id",
        "model_path",
        configuration_id(
            F.lit("logistic"), F.col("specification"), parameters, F.lit(None).cast("int")
        ).alias("configuration_id"),
    )


@query(
    "prj1_canonical_names",
    """SELECT CAST(year AS VARCHAR) AS year, CAST(loan_purp AS VARCHAR) AS loan_purp,
    CAST(occupancy AS VARCHAR) AS occupancy, resp_id, seq_num FROM loans""",
)
def _(spark, sf):
    frame = source_loans.canonical_columns(text_loans(spark, sf))
    return frame.select("year", "loan_purp", "occupancy", "resp_id", "seq_num")


@query(
    "prj2_first_alias",
    """SELECT 'first' AS source, 'loan_amount' AS field, 'loan_amt' AS column_name, count(loan_amt) AS n FROM loans
    UNION ALL SELECT 'second', 'loan_amount', 'loan_amount_000s', count(loan_amt) FROM loans
    UNION ALL SELECT 'first', 'occupancy', 'occupancy', count(occupancy) FROM loans
    UNION ALL SELECT 'second', 'occupancy', 'occupancy_type', count(occupancy) FROM loans""",
)
def _(spark, sf):
    from ..domain import FIELD_ALIASES

    frames = {"first": loans(spark, sf), "second": inputs.second_source(spark, sf)}
    result = None
    for source, frame in frames.items():
        for field in ("loan_amount", "occupancy"):
            name = source_loans.first_present(frame.columns, FIELD_ALIASES[field])
            part = frame.agg(F.count(name).alias("n")).select(
                F.lit(source).alias("source"),
                F.lit(field).alias("field"),
                F.lit(name).alias("column_name"),
                "n",
            )
            result = part if result is None else result.unionByName(part)
    return result


@query(
    "prj3_requested_columns",
    "SELECT year, action_taken, loan_type, lien_status FROM loans",
)
def _(spark, sf):
    wanted = ["as_of_year", "action_taken", "missing_optional", "loan_type", "year", "lien_status"]
    frame = source_loans.canonical_columns(loans(spark, sf))
    return source_loans.project(frame, wanted, allow_missing=True)


@query(
    "prj4_numeric_coercion",
    f"""SELECT seq_num, {r('loan_amt', 'app_income', 'edit_status', 'state_code', 'county_code')} FROM texts""",
    texts=TEXT,
)
def _(spark, sf):
    frame = source_loans.numeric_columns(source_loans.canonical_columns(text_loans(spark, sf)))
    return frame.select(
        "seq_num", "loan_amt", "app_income", "edit_status", "state_code", "county_code"
    )


@query(
    "prj5_feature_sets",
    f"""SELECT 'core' AS feature_set, year, lien_status, {r('log_lti', 'log_county_value_to_loan')},
    purchaser_type, loan_type, state_code FROM core
    UNION ALL SELECT 'restricted', year, lien_status, round(log_lti, 6), NULL, purchaser_type, loan_type,
    state_code FROM clean""",
)
def _(spark, sf):
    full = inputs.core(spark, sf).select(*sinks.selection_columns("core", DOMAIN))
    narrow = inputs.restricted(spark, sf).select(*sinks.selection_columns("restricted", DOMAIN))
    return full.withColumn("feature_set", F.lit("core")).unionByName(
        narrow.withColumn("feature_set", F.lit("restricted")), allowMissingColumns=True
    )


@query(
    "prj6_county_key",
    "SELECT seq_num, CAST(1000 * state_code + county_code AS BIGINT) AS fips FROM loans",
)
def _(spark, sf):
    return loans(spark, sf).select("seq_num", clean.county_key().alias("fips"))


@query(
    "prj7_log_loan_to_income",
    """SELECT seq_num, round(CASE WHEN app_income > 0 THEN ln(loan_amt / app_income) END, 6) AS log_lti
    FROM loans""",
)
def _(spark, sf):
    value = F.when(F.col("app_income") > 0, clean.log_loan_to_income())
    return loans(spark, sf).select("seq_num", value.alias("log_lti"))


@query(
    "prj8_log_value_to_loan",
    f"SELECT seq_num, {r('county_value', 'log_county_value_to_loan')} FROM core",
)
def _(spark, sf):
    return inputs.core(spark, sf).select("seq_num", "county_value", "log_county_value_to_loan")


@query(
    "prj9_flags",
    """SELECT seq_num, COALESCE(edit_status, 0) AS edit_status, edit_status IS NOT NULL AS has_edit_status,
    loan_amt < 10 AS loan_below_10k FROM loans""",
)
def _(spark, sf):
    return clean.flag_columns(loans(spark, sf)).select(
        "seq_num", "edit_status", "has_edit_status", "loan_below_10k"
    )


@query(
    "prj10_pinned_levels",
    """SELECT CASE WHEN loan_type BETWEEN 1 AND 4 THEN loan_type END AS loan_type, purchaser_type, count(*) AS n
    FROM loans GROUP BY 1, 2""",
)
def _(spark, sf):
    pinned = clean.pin_levels(loans(spark, sf), domain=DOMAIN)
    return pinned.groupBy("loan_type", "purchaser_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj11_region",
    f"""SELECT state_code, {REGION_CASE} IS NOT NULL AS has_region, count(*) AS n
    FROM (SELECT CAST(state_code AS BIGINT) AS state_code FROM loans) g GROUP BY 1, 2""",
)
def _(spark, sf):
    return clean.unmapped_states(loans(spark, sf), DOMAIN)


@query(
    "prj12_hard_class",
    """SELECT year, CASE WHEN probability >= 0.5 THEN 2 ELSE 1 END AS predicted, lien_status, count(*) AS n
    FROM one GROUP BY ALL""",
)
def _(spark, sf):
    frame = inputs.one_model(spark, sf)
    return frame.groupBy(
        "year", hard_class(F.col("probability")).alias("predicted"), "lien_status"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("flt1_sample", "SELECT seq_num, year FROM clean")
def _(spark, sf):
    return clean.restrict_sample(loans(spark, sf), DOMAIN).select("seq_num", "year")


@query(
    "flt2_label_policy",
    """SELECT year, count(*) AS n, count(CASE WHEN year >= 1997 THEN lien_status END) AS n_labelled,
    year < 1997 AS is_unlabelled FROM clean GROUP BY year""",
)
def _(spark, sf):
    domain = Domain(first_labelled_year=1997)
    raw = source_loans.apply_label_policy(loans(spark, sf), "allow", domain)
    cleaned = clean.clean_loans(raw, domain=domain, unlabelled_before=1997)
    empty = source_loans.unlabelled_years(cleaned, domain).select(
        "year", F.lit(True).alias("_empty")
    )
    counts = cleaned.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count("lien_status").alias("n_labelled")
    )
    return counts.join(empty, "year", "left").select(
        "year", "n", "n_labelled", F.coalesce("_empty", F.lit(False)).alias("is_unlabelled")
    )


@query(
    "flt3_complete_features",
    "SELECT year, count(*) AS n, count(log_county_value_to_loan) AS n_complete FROM core GROUP BY year",
)
def _(spark, sf):
    return inputs.core(spark, sf).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count("log_county_value_to_loan").alias("n_complete")
    )


@query(
    "flt4_missing_tokens",
    """SELECT year, count(*) AS n, count(loan_amt) AS n_amount, count(app_income) AS n_income,
    count(edit_status) AS n_edit, count(county_code) AS n_county
    FROM (SELECT CAST(year AS VARCHAR) AS year, loan_amt, app_income, edit_status, county_code FROM texts) g
    GROUP BY year""",
    texts=TEXT,
)
def _(spark, sf):
    names = {
        "n_amount": "loan_amount_000s",
        "n_income": "applicant_income_000s",
        "n_edit": "edit_status",
        "n_county": "county_code",
    }
    return text_loans(spark, sf).groupBy(F.col("as_of_year").alias("year")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(present_token(F.col(c))).alias(n) for n, c in names.items()],
    )


@query(
    "flt5_stage_masks",
    """SELECT year, count(*) AS raw, count(*) FILTER (t1) AS originated_purchase_owner_occupied,
    count(*) FILTER (t1 AND t2) AS nonmissing_lien_status,
    count(*) FILTER (t1 AND t2 AND t3) AS valid_geography,
    count(*) FILTER (t1 AND t2 AND t3 AND t4) AS positive_income_and_loan_amount,
    count(*) FILTER (t1 AND t2 AND t3 AND t4 AND t5) AS valid_loan_type FROM stage_loans GROUP BY year""",
)
def _(spark, sf):
    cube = stage_cube(loans(spark, sf), DOMAIN)
    names = [n for n in cube.columns if n not in ("year", "label", "county")]
    return cube.groupBy("year").agg(*[F.sum(n).alias(n) for n in names])


@query(
    "flt6_probability_checks",
    """SELECT validation_year, count(*) FILTER (p IS NULL) AS n_non_finite,
    count(*) FILTER (p < 0 OR p > 1) AS n_outside_unit, 0::BIGINT AS n_unlabelled,
    count(*) FILTER (y) * count(*) FILTER (NOT y) = 0 AS is_single_class
    FROM (SELECT validation_year, y, CASE WHEN log_ratio > -2 THEN probability * 4 END AS p FROM scored) g
    GROUP BY 1""",
)
def _(spark, sf):
    spoiled = F.when(F.col("log_ratio") > -2, F.col("probability") * 4)
    frame = inputs.scored(spark, sf).withColumn("probability", spoiled)
    return probability_violations(frame, ["validation_year"], positive())


@query(
    "flt7_model_inputs",
    """SELECT year, count(*) FILTER (app_income <= 0) AS log_lti_non_finite, 0::BIGINT AS purchaser_type_unknown,
    count(*) FILTER (loan_type = 5) AS loan_type_unknown,
    count(*) FILTER (state_code IN (3, 7, 14)) AS region_missing FROM loans GROUP BY year""",
)
def _(spark, sf):
    frame = loans(spark, sf).withColumn(
        "log_lti", F.when(F.col("app_income") > 0, clean.log_loan_to_income())
    )
    return input_violations(frame, ["year"], ["log_lti"], geography="region", domain=DOMAIN)


@query(
    "flt8_cell_rules",
    """SELECT specification, regularization_c, train_start, validation_year, rule FROM (
      SELECT *, 'mixture_share_unit_interval' AS rule FROM cells WHERE mean_log_ratio NOT BETWEEN 0 AND 1
      UNION ALL SELECT *, 'hard_share_050_unit_interval' FROM cells WHERE NOT hard_share * 5 <= 1
      UNION ALL SELECT *, 'horizon_positive' FROM cells WHERE horizon - 1 <= 0
      UNION ALL SELECT *, 'log_loss_nonnegative' FROM cells WHERE log_loss - 0.45 < 0) g""",
)
def _(spark, sf):
    spoiled = inputs.cells(spark, sf).withColumns(
        {
            "n_observations": F.col("n"),
            "mixture_share": F.col("mean_log_ratio"),
            "hard_share_050": F.col("hard_share") * 5,
            "horizon": F.col("horizon") - 1,
            "log_loss": F.col("log_loss") - 0.45,
        }
    )
    keys = ["specification", "regularization_c", "train_start", "validation_year", "rule"]
    return cell_violations(spoiled).select(*keys)


@query(
    "flt9_close_penalty",
    f"""SELECT specification, train_start, validation_year, {r('brier_score')} FROM cells
    WHERE abs(regularization_c - 1.0000000001) <= 1e-8 + 1e-5 * 1.0000000001""",
)
def _(spark, sf):
    close = is_close(F.col("regularization_c"), F.lit(1.0000000001))
    return inputs.cells(spark, sf).where(close).select(
        "specification", "train_start", "validation_year", "brier_score"
    )
