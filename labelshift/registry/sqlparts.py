"""ANSI SQL of the shared inputs, composed into one WITH clause per query."""

from __future__ import annotations

import re

from .inputs import CANDIDATES, LABEL_SHIFT

REGION_CASE = """CASE
  WHEN state_code IN (9,23,25,33,34,36,42,44,50) THEN 'northeast'
  WHEN state_code IN (17,18,19,20,26,27,29,31,38,39,46,55) THEN 'midwest'
  WHEN state_code IN (1,5,10,11,12,13,21,22,24,28,37,40,45,47,48,51,54) THEN 'south'
  WHEN state_code IN (2,4,6,8,15,16,30,32,35,41,49,53,56) THEN 'west' END"""

_candidates = ",\n  ".join(
    f"('{c[0]}', {', '.join(f'CAST({v!r} AS DOUBLE)' for v in c[1:])})" for c in CANDIDATES
)

PARTS = {
    "loans": """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE o_orderstatus WHEN 'P' THEN 2 ELSE 1 END AS action_taken,
  CASE WHEN o_orderkey % 10 < 8 THEN 1 ELSE 3 END AS loan_purp,
  CASE WHEN o_custkey % 20 = 0 THEN 2 ELSE 1 END AS occupancy,
  CAST(1 + o_orderkey % 3 AS INTEGER) AS agency_code,
  CAST(1 + o_orderkey % 5 AS INTEGER) AS loan_type,
  o_totalprice / 1000 AS loan_amt,
  c_acctbal / 50 AS app_income,
  CAST(o_custkey % 10 AS INTEGER) AS purchaser_type,
  CASE WHEN o_orderkey % 7 = 0 THEN 5 END AS edit_status,
  c_nationkey + 1 AS state_code,
  CAST(CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE 1 + c_custkey % 3 END AS INTEGER) AS county_code,
  CASE WHEN (o_orderkey * 7919) % 1000 < CASE WHEN o_totalprice < 100000 THEN 550 ELSE 60 END
    THEN 2 ELSE 1 END AS lien_status,
  o_custkey AS resp_id, o_orderkey AS seq_num
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "stage_loans": """
SELECT *, 1000.0 * state_code + county_code AS county,
  TRUE AS s0,
  action_taken = 1 AND loan_purp = 1 AND occupancy = 1 AS t1,
  lien_status IS NOT NULL AS t2,
  state_code BETWEEN 1 AND 56 AND state_code NOT IN (3, 7, 14, 43, 52) AND county_code >= 1 AS t3,
  app_income >= 1 AND loan_amt >= 1 AS t4,
  loan_type BETWEEN 1 AND 4 AS t5
FROM loans""",
    "clean": """
SELECT year, agency_code, loan_type, loan_amt, app_income, purchaser_type,
  COALESCE(edit_status, 0) AS edit_status, CAST(state_code AS BIGINT) AS state_code, lien_status,
  resp_id, seq_num, CAST(1000 * state_code + county_code AS BIGINT) AS fips,
  ln(loan_amt / app_income) AS log_lti, edit_status IS NOT NULL AS has_edit_status,
  loan_amt < 10 AS loan_below_10k
FROM stage_loans WHERE t1 AND t2 AND t3 AND t4 AND t5""",
    "hpi": """
SELECT fips, year, hpi, round(100 * hpi / arg_min(hpi, year) OVER (PARTITION BY fips), 6) AS hpi_1990_base
FROM (SELECT CAST(1000 * (c_nationkey + 1)
        + CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE 1 + c_custkey % 3 END AS BIGINT) AS fips,
      CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_extendedprice / l_quantity) AS hpi
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    GROUP BY 1, 2) g""",
    "monthly": """
SELECT CAST(1000 * (c_nationkey + 1)
    + CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE 1 + c_custkey % 3 END AS BIGINT) AS fips,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS zhvi
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "annual": """
SELECT fips, CAST(year(date) AS INTEGER) AS year, avg(zhvi) AS zhvi, count(*) AS n_zhvi_months
FROM monthly WHERE fips IS NOT NULL AND zhvi IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 12""",
    "overlap": """
SELECT h.fips, h.year, hpi, zhvi, n_zhvi_months, ln(hpi) AS log_hpi, ln(zhvi) AS log_zhvi,
  ln(zhvi) - ln(hpi) AS log_ratio
FROM hpi h JOIN annual a ON h.fips = a.fips AND h.year = a.year WHERE hpi > 0 AND zhvi > 0""",
    "scales": """
SELECT fips, count(*) AS n_overlap_years, min(year) AS first_overlap_year,
  max(year) AS last_overlap_year, exp(avg(log_ratio)) AS scale_geometric,
  sum(hpi * zhvi) / sum(hpi * hpi) AS scale_ols_origin,
  exp(median(log_ratio)) AS scale_median_log_ratio,
  exp(max(CASE WHEN year = 1998 THEN log_ratio END)) AS scale_anchor_2017,
  stddev_pop(log_ratio) AS log_rmse_geometric, stddev_pop(log_ratio) AS log_ratio_sd,
  CASE WHEN count(*) >= 2 AND var_pop(log_hpi) > 0
    THEN covar_pop(year, log_ratio) / var_pop(year) END AS log_ratio_time_trend,
  CASE WHEN count(*) >= 2 AND var_pop(log_hpi) > 0
    THEN covar_pop(log_hpi, log_zhvi) / var_pop(log_hpi) END AS unrestricted_log_slope
FROM overlap GROUP BY fips""",
    "panel": """
SELECT h.fips, h.year, h.hpi, h.hpi * s.scale_geometric AS county_value
FROM hpi h JOIN scales s ON h.fips = s.fips
WHERE h.year BETWEEN 1995 AND 2001 AND h.hpi > 0 AND s.n_overlap_years >= 1""",
    "core": """
SELECT c.*, p.hpi, p.county_value, ln(p.county_value / (1000.0 * c.loan_amt)) AS log_county_value_to_loan
FROM clean c JOIN panel p ON c.fips = p.fips AND c.year = p.year""",
    "coverage_keys": """
SELECT fips, year, count(*) OVER (PARTITION BY fips) = 7 AS is_balanced
FROM (SELECT DISTINCT fips, year FROM hpi WHERE year BETWEEN 1995 AND 2001 AND hpi IS NOT NULL) k""",
    "matched": """
SELECT l.*, k.fips IS NOT NULL AS in_year, b.fips IS NOT NULL AS in_balanced
FROM stage_loans l
LEFT JOIN coverage_keys k ON k.fips = l.county AND k.year = l.year
LEFT JOIN (SELECT DISTINCT fips FROM coverage_keys WHERE is_balanced) b ON b.fips = l.county""",
    "folds": """
SELECT 'reverse__train_' || s || '_' || (s + 3) || '__target_' || f || '_' || (s - 1) AS fold_id,
  CAST(s AS INTEGER) AS train_start, CAST(s + 3 AS INTEGER) AS train_end, CAST(f AS INTEGER) AS first_year
FROM (SELECT f, unnest(range(f + 1, l - 2)) AS s
  FROM (SELECT min(year) AS f, max(year) AS l FROM clean WHERE lien_status IS NOT NULL) y) g""",
    "targets": """
SELECT fold_id, train_start, train_end, CAST(v AS INTEGER) AS validation_year,
  CAST(train_start - v AS INTEGER) AS horizon
FROM (SELECT *, unnest(range(first_year, train_start)) AS v FROM folds) g""",
    "sources": """
SELECT fold_id, train_start, train_end, CAST(y AS INTEGER) AS year
FROM (SELECT *, unnest(range(train_start, train_end + 1)) AS y FROM folds) g""",
    "candidates": f"""
SELECT * FROM (VALUES
  {_candidates}) v(specification, regularization_c, k, x, t, p, c, w)""",
    "scored": f"""
SELECT *, 1 / (1 + exp(-(log_ratio + {LABEL_SHIFT!r}))) AS probability, lien_status = 2 AS y
FROM (SELECT specification, regularization_c, fold_id, train_start, train_end, validation_year,
    horizon, lien_status, log_lti, loan_type, purchaser_type, state_code,
    k + x * log_lti + t * CASE WHEN loan_type = 2 THEN 1 ELSE 0 END + p * purchaser_type
      + c * power(greatest(log_lti, 0), 3)
      + w * CASE WHEN ({REGION_CASE}) = 'west' THEN 1 ELSE 0 END
      + 0.05 * (train_start - 1996) AS log_ratio
  FROM clean JOIN targets ON clean.year = targets.validation_year CROSS JOIN candidates) g""",
    "one": f"""
SELECT *, 1 / (1 + exp(-(log_ratio + {LABEL_SHIFT!r}))) AS probability, lien_status = 2 AS y
FROM (SELECT *, 0.10 - 0.70 * log_lti + 0.02 * purchaser_type
    + 0.05 * power(greatest(log_lti, 0), 3) AS log_ratio FROM clean) g""",
    "cells": """
SELECT *, split_part(specification, '__', 1) AS continuous_form,
  split_part(specification, '__', 2) AS interactions,
  CASE WHEN split_part(specification, '__', 3) = '' THEN 'none'
    ELSE split_part(specification, '__', 3) END AS geography,
  mean_probability - actual_second_share AS mixture_share_error
FROM (SELECT specification, regularization_c, fold_id, train_start, train_end, validation_year,
    horizon, count(*) AS n, avg(power(probability - CAST(y AS INTEGER), 2)) AS brier_score,
    avg(-CASE WHEN y THEN ln(probability) ELSE ln(1 - probability) END) AS log_loss,
    avg(CAST(y AS INTEGER)) AS actual_second_share, avg(probability) AS mean_probability,
    avg(CASE WHEN probability >= 0.25 THEN 1.0 ELSE 0.0 END) AS hard_share,
    avg(log_ratio) AS mean_log_ratio
  FROM scored GROUP BY ALL) g""",
    "docs": """
SELECT *, 1 / (1 + exp(-log_ratio)) AS probability, quality = 1 AS y
FROM (SELECT d.doc_id, d.lang, d.source, l.quality, length(d.text) AS n_characters,
    0.4 * (ln(length(d.text) + 1.0) - 6.0) AS log_ratio
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) g""",
}


def needed(text: str, extra: dict[str, str]) -> list[str]:
    """Shared parts a statement uses, dependencies first."""
    known = {**PARTS, **extra}
    order: list[str] = []

    def visit(body: str, own: str | None) -> None:
        for name in known:
            if name != own and name not in order and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", body):
                visit(known[name], name)
                if name not in order:
                    order.append(name)

    visit(text, None)
    return order


def compose(body: str, **extra: str) -> str:
    """The body with every shared or extra part it needs in front."""
    known = {**PARTS, **extra}
    parts = [f"{name} AS MATERIALIZED ({known[name]})" for name in needed(body, extra)]
    return f"WITH {', '.join(parts)}\n{body}" if parts else body
