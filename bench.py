"""Benchmark: headline queries at $BENCH_SF_DIR and fit/predict throughput.

Prints one JSON line. Throughput is measured on records derived from the given
tables, copied $BENCH_COPIES times with a small deterministic shift, so that it
can be set against published rows per second.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from labelshift.models import logistic, trees
from labelshift.plans.specifications import parse_specification
from labelshift.registry import QUERIES, inputs
from labelshift.session import local_session

HEADLINE = (
    "attrition_by_year",
    "agg1_stage_counts",
    "agg4_coverage",
    "agg11_county_scales",
    "agg12_value_panel",
    "agg14_source_profile",
    "jon1_records_with_county_value",
    "agg17_geographic_support",
    "agg18_equal_prior_weights",
    "agg20_brier_summary",
    "jon15_plan_differences",
    "fea2_cubic_basis",
    "est1_ridge_path",
    "est2_selected_model",
    "est4_known_source_prior",
    "est7_linear_log_ratio",
    "est10_mixture_share",
    "est14_calibration",
    "evl1_proper_scores",
    "evl3_average_precision",
    "evl4_precision_recall_counts",
    "evl5_mixture_cells",
    "bin1_reliability_bins",
    "bin4_all_subgroups",
    "rpt7_release_crosswalk",
    "rpt8_paired_comparison",
)
SOURCE_YEARS = tuple(range(1995, 2002))


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def copied(frame, copies: int):
    """Derived records at larger scale, stored once and read back."""
    shifted = F.col("log_lti") + 0.01 * F.sin(F.col("copy") * 1.7 + F.col("log_lti") * 100)
    path = f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/records"
    (
        frame.repartition(16)
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
        .withColumn("log_lti", shifted)
        .drop("copy")
        .write.parquet(path)
    )
    return frame.sparkSession.read.parquet(path)


def throughput(spark, sf_dir: str, copies: int) -> dict[str, float]:
    columns = ["year", "lien_status", "log_lti", "loan_type", "purchaser_type", "state_code"]
    narrow = copied(inputs.restricted(spark, sf_dir).select(*columns), copies)
    n = narrow.count()
    spec = parse_specification("restricted__spline_lti__purchaser_type")
    fitted = []
    fit = timed(
        lambda: fitted.append(
            logistic.fit_model(narrow, spec, 0.1, SOURCE_YEARS, domain=inputs.DOMAIN)
        )
    )
    predict = timed(lambda: run(fitted[0].predict_probability(narrow).select("probability")))
    forest_copies = max(1, copies // 5)
    core = [*columns, "log_county_value_to_loan"]
    wide = copied(inputs.core(spark, sf_dir).select(*core), forest_copies)
    m = wide.count()
    forests = []
    forest_fit = timed(
        lambda: forests.append(trees.fit_forest(wide, SOURCE_YEARS, domain=inputs.DOMAIN))
    )
    larger = copied(wide, 5)
    forest_predict = timed(lambda: run(forests[0].probability(larger).select("probability")))
    return {
        "logistic_rows": n,
        "logistic_fit_sec": fit,
        "logistic_fit_rows_per_sec": round(n / fit),
        "logistic_predict_rows_per_sec": round(n / predict),
        "forest_rows": m,
        "forest_fit_sec": forest_fit,
        "forest_fit_rows_per_sec": round(m / forest_fit),
        "forest_predict_rows_per_sec": round(5 * m / forest_predict),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    copies = int(os.environ.get("BENCH_COPIES", "192"))
    spark = local_session(app="labelshift-bench")
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["attrition_by_year"](spark, sf_dir))
    times = {}
    for name in HEADLINE:
        times[name] = timed(lambda name=name: run(QUERIES[name](spark, sf_dir)))
        spark.catalog.clearCache()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    if copies > 0:
        result["throughput"] = throughput(spark, sf_dir, copies)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
