"""Feature expansion fitted on training folds and applied as expressions.

Fold statistics are fitted for all folds in one aggregate. A feature is a
column expression over *parameters*, which are either literals of one model or
columns of a joined parameter table, so one plan serves every fold at once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import DEFAULT, REGION_LEVELS, STATE_LEVELS, Domain
from ..functions.expressions import indicator
from ..functions.local import small_table
from ..plans.specifications import SPLINE_INTERACTION, FeatureSpec
from .clean import region_of
from .quantiles import exact_quantiles

# Knot positions of the cubic basis and the year-effect scale.
SPLINE_QUANTILES = (0.05, 0.35, 0.65, 0.95)
YEAR_EFFECT_SCALE = 100.0

Parameter = Callable[[str], Column]


def literal_parameters(values: Mapping[str, float]) -> Parameter:
    return lambda name: F.lit(float(values[name]))


def column_parameters() -> Parameter:
    return lambda name: F.col(name)


def knot_names(variable: str) -> list[str]:
    return [f"{variable}__knot_{i}" for i in range(1, len(SPLINE_QUANTILES) + 1)]


def cubic_basis(value: Column, knots: Sequence[Column]) -> list[Column]:
    """Natural cubic basis: the value and one curved term per inner knot."""
    first, penultimate, last = knots[0], knots[-2], knots[-1]
    width, scale = last - penultimate, (last - first) * (last - first)

    def cube(knot: Column) -> Column:
        held = F.greatest(value - knot, F.lit(0.0))
        return held * held * held

    terms = [value]
    for knot in knots[:-2]:
        tail = (penultimate - knot) / width * cube(last) - (last - knot) / width * cube(penultimate)
        terms.append((cube(knot) + tail) / scale)
    return terms


@dataclass(frozen=True)
class Term:
    """One model feature: an optional factor times an optional level indicator."""

    name: str
    factor: str | None = None
    category: str | None = None
    level: int | str | None = None


def category_levels(domain: Domain = DEFAULT) -> dict[str, tuple]:
    """Declared levels of everything a feature can be an indicator of."""
    return {**domain.categories, "region": REGION_LEVELS, "state": STATE_LEVELS}


def category_column(category: str, domain: Domain = DEFAULT) -> Column:
    if category == "state":
        return F.col(domain.region_column).cast("long")
    if category == "region":
        return region_of(F.col(domain.region_column).cast("long"))
    return F.col(category)


def indicator_terms(category: str, levels: Sequence) -> list[Term]:
    """Reference coding: every level but the first; null is all zero."""
    return [Term(f"{category}_{level}", None, category, level) for level in levels[1:]]


def interaction_variables(interactions: str) -> tuple[str, ...]:
    if interactions == "both":
        return ("loan_type", "purchaser_type")
    if interactions == SPLINE_INTERACTION:
        return ("purchaser_type",)
    return () if interactions == "none" else (interactions,)


def spline_factors(variable: str) -> list[str]:
    return [f"{variable}_rcs_{i}" for i in range(1, len(SPLINE_QUANTILES))]


def feature_terms(spec: FeatureSpec, domain: Domain = DEFAULT) -> list[Term]:
    """All features of a specification in model order."""
    variables = spec.inputs(domain)
    main = {v: spline_factors(v) if spec.uses_spline(v) else [v] for v in variables}
    terms = [Term(factor, factor) for v in variables for factor in main[v]]
    for category, levels in domain.categories.items():
        terms += indicator_terms(category, levels)
    for category in interaction_variables(spec.interactions):
        for variable in variables:
            curved = spec.interactions == SPLINE_INTERACTION and variable == "log_lti"
            for factor in main[variable] if curved else [variable]:
                terms += [
                    Term(f"{factor}_x_{term.name}", factor, category, term.level)
                    for term in indicator_terms(category, domain.categories[category])
                ]
    if spec.geography is not None:
        terms += indicator_terms(spec.geography, category_levels(domain)[spec.geography])
    return terms


def factor_columns(
    spec: FeatureSpec, parameter: Parameter, domain: Domain = DEFAULT
) -> dict[str, Column]:
    """Standardised continuous factors of the features."""
    columns: dict[str, Column] = {}
    for variable in spec.inputs(domain):
        x = F.col(variable)
        columns[variable] = (x - parameter(f"{variable}__mean")) / parameter(f"{variable}__sd")
        if spec.uses_spline(variable):
            terms = cubic_basis(x, [parameter(name) for name in knot_names(variable)])
            for i, (name, term) in enumerate(
                zip(spline_factors(variable), terms, strict=True), start=1
            ):
                location = parameter(f"{variable}__basis_mean_{i}")
                columns[name] = (term - location) / parameter(f"{variable}__basis_sd_{i}")
    used = {term.factor for term in feature_terms(spec, domain)}
    return {name: column for name, column in columns.items() if name in used}


def feature_columns(
    spec: FeatureSpec, parameter: Parameter, domain: Domain = DEFAULT
) -> dict[str, Column]:
    """Ordered name → expression of every model feature of a specification."""
    factors = factor_columns(spec, parameter, domain)
    columns = {}
    for term in feature_terms(spec, domain):
        parts = [] if term.factor is None else [factors[term.factor]]
        if term.category is not None:
            parts.append(indicator(category_column(term.category, domain) == term.level))
        columns[term.name] = parts[0] if len(parts) == 1 else parts[0] * parts[1]
    return columns


def year_terms(window: int) -> list[Term]:
    """Source-year block by place in the training window; the first is the reference."""
    return [
        Term(f"year_{position}", None, "year_position", position) for position in range(1, window)
    ]


def year_indicators(window: int, scale: float = YEAR_EFFECT_SCALE) -> dict[str, Column]:
    """The scaled source-year block as columns."""
    return {
        term.name: indicator(F.col("year_position") == term.level) * scale
        for term in year_terms(window)
    }


def full_indicators(value: Column, levels: Sequence, prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{level}": indicator(value == level) for level in levels}


def forest_columns(domain: Domain = DEFAULT) -> dict[str, Column]:
    """Raw continuous inputs and every level of each category."""
    columns = {name: F.col(name).cast("float").cast("double") for name in domain.continuous}
    for name, levels in domain.categories.items():
        columns.update(full_indicators(F.col(name), levels, name))
    return columns


def boosting_columns(feature_set: str = "core", domain: Domain = DEFAULT) -> dict[str, Column]:
    """Raw continuous inputs and zero-based category codes."""
    columns = {name: F.col(name).cast("double") for name in domain.inputs(feature_set)}
    for name, levels in domain.categories.items():
        position = F.array_position(F.array(*map(F.lit, levels)), F.col(name).cast("int")) - 1
        columns[name] = position.cast("double")
    return columns


def nominal_metadata(name: str, levels: Sequence) -> dict:
    """ML attribute that makes trees split a code as unordered levels."""
    values = [str(level) for level in levels]
    return {"ml_attr": {"type": "nominal", "name": name, "vals": values}}


def violation_counts(
    continuous: Sequence[str],
    *,
    geography: str | None = None,
    nulls_allowed: bool = True,
    domain: Domain = DEFAULT,
) -> list[Column]:
    """Aggregates counting the records a model cannot use, per reason."""
    tests = {}
    for name in continuous:
        value = F.col(name).cast("double")
        tests[f"{name}_non_finite"] = (
            value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
        )
    for name, levels in domain.categories.items():
        known = F.col(name).isin(*levels)
        tests[f"{name}_unknown"] = ~F.coalesce(known, F.lit(nulls_allowed))
    if geography == "region":
        tests["region_missing"] = region_of(F.col(domain.region_column).cast("long")).isNull()
    if geography == "state":
        state = F.col(domain.region_column).cast("long").isin(*STATE_LEVELS)
        tests["state_unknown"] = ~F.coalesce(state, F.lit(True))
    return [F.count_if(test).alias(name) for name, test in tests.items()]


def input_violations(
    frame: DataFrame, keys: Sequence[str], continuous: Sequence[str], **options
) -> DataFrame:
    return frame.groupBy(*keys).agg(*violation_counts(continuous, **options))


def require_inputs(frame: DataFrame, continuous: Sequence[str], **options) -> None:
    raise_violations(input_violations(frame, (), continuous, **options).first().asDict())


def raise_violations(counts: Mapping[str, int]) -> None:
    broken = {name: count for name, count in counts.items() if count}
    if broken:
        raise ValueError(f"Records violate the model inputs: {broken}")


def fit_feature_parameters(
    training: DataFrame, spec: FeatureSpec, key: str = "fold_id", domain: Domain = DEFAULT
) -> dict[str, dict[str, float]]:
    """Location, scale, knots and basis moments of every fold.

    Returns one small dictionary per fold. Population moments; a constant input,
    tied knots or records outside the declared inputs raise.
    """
    variables = spec.inputs(domain)
    checks = violation_counts(variables, geography=spec.geography, domain=domain)
    moments = [
        aggregate
        for name in variables
        for aggregate in (
            F.avg(name).alias(f"{name}__mean"),
            F.stddev_pop(name).alias(f"{name}__sd"),
        )
    ]
    fitted = {}
    for row in training.groupBy(key).agg(*moments, *checks).collect():
        values = {name: v for name, v in row.asDict().items() if name != key}
        kept = {name: v for name, v in values.items() if name.endswith(("__mean", "__sd"))}
        raise_violations({name: v for name, v in values.items() if name not in kept})
        fitted[row[key]] = kept
    curved = [name for name in variables if spec.uses_spline(name)]
    for name in curved:
        knots = exact_quantiles(training, [key], name, SPLINE_QUANTILES, "knots").collect()
        for row in knots:
            if len(set(row["knots"])) != len(SPLINE_QUANTILES):
                raise ValueError(f"The spline of {name} has coinciding knots")
            fitted[row[key]].update(zip(knot_names(name), row["knots"], strict=True))
    if curved:
        joined = join_parameters(training, fitted, key)
        aggregates = []
        for name in curved:
            terms = cubic_basis(F.col(name), [F.col(knot) for knot in knot_names(name)])
            for i, term in enumerate(terms, start=1):
                aggregates.append(F.avg(term).alias(f"{name}__basis_mean_{i}"))
                aggregates.append(F.stddev_pop(term).alias(f"{name}__basis_sd_{i}"))
        for row in joined.groupBy(key).agg(*aggregates).collect():
            fitted[row[key]].update({k: v for k, v in row.asDict().items() if k != key})
    for values in fitted.values():
        if any("_sd" in name and not value > 0 for name, value in values.items()):
            raise ValueError("A feature has no spread or no finite spread, so it has no standard scale")
    return fitted


def parameter_table(
    spark: SparkSession, fitted: Mapping[str | int, Mapping[str, float]], key: str = "fold_id"
) -> DataFrame:
    names = sorted({name for values in fitted.values() for name in values})
    rows = [(fold, *[float(values[name]) for name in names]) for fold, values in fitted.items()]
    kind = "int" if isinstance(next(iter(fitted)), int) else "string"
    schema = ", ".join([f"{key} {kind}", *[f"{name} double" for name in names]])
    return small_table(spark, rows, schema)


def join_parameters(
    frame: DataFrame, fitted: Mapping[str, Mapping[str, float]], key: str = "fold_id"
) -> DataFrame:
    """Attach each fold's parameters; the table has one row per fold."""
    return frame.join(F.broadcast(parameter_table(frame.sparkSession, fitted, key)), key)
