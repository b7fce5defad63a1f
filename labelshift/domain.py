"""Names, codes and levels of the record domain.

Every operator takes a :class:`Domain`, so a table whose label, categories or
filters differ from the default loan layout needs another instance, not other
code.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# Census region of each numeric state code.
NORTHEAST = (9, 23, 25, 33, 34, 36, 42, 44, 50)
MIDWEST = (17, 18, 19, 20, 26, 27, 29, 31, 38, 39, 46, 55)
SOUTH = (1, 5, 10, 11, 12, 13, 21, 22, 24, 28, 37, 40, 45, 47, 48, 51, 54)
WEST = (2, 4, 6, 8, 15, 16, 30, 32, 35, 41, 49, 53, 56)
REGION_LEVELS = ("south", "northeast", "midwest", "west")
REGION_STATES = {
    "south": SOUTH,
    "northeast": NORTHEAST,
    "midwest": MIDWEST,
    "west": WEST,
}
STATE_LEVELS = tuple(sorted(SOUTH + NORTHEAST + MIDWEST + WEST))

# Input column names of the known providers and the internal name.
COLUMN_ALIASES = {
    "activity_year": "year",
    "asof_date": "year",
    "as_of_year": "year",
    "respondent_id": "resp_id",
    "loan_purpose": "loan_purp",
    "occupancy_type": "occupancy",
    "owner_occupancy": "occupancy",
    "loan_amount_000s": "loan_amt",
    "applicant_income_000s": "app_income",
    "sequence_number": "seq_num",
}

# Report fields and the names under which providers store them.
FIELD_ALIASES = {
    "year": ("activity_year", "as_of_year", "asof_date"),
    "loan_type": ("loan_type",),
    "loan_purpose": ("loan_purpose", "loan_purp"),
    "occupancy": ("occupancy_type", "owner_occupancy", "occupancy"),
    "loan_amount": ("loan_amount", "loan_amount_000s", "loan_amt"),
    "action_taken": ("action_taken",),
    "msa": ("derived_msa_md", "msa_md", "msamd", "prop_msa"),
    "state": ("state_code",),
    "county": ("county_code",),
    "census_tract": ("census_tract", "census_tract_number"),
    "income": ("income", "applicant_income_000s", "app_income"),
    "purchaser_type": ("purchaser_type",),
    "lien_status": ("lien_status",),
}
FREQUENCY_FIELDS = (
    "year",
    "loan_type",
    "loan_purpose",
    "occupancy",
    "action_taken",
    "state",
    "purchaser_type",
    "lien_status",
)
DISTINCT_FIELDS = (*FREQUENCY_FIELDS, "msa", "county", "census_tract")
MISSING_TOKENS = ("", "NA", "N/A", "NULL", "null")

# Attrition stages in order.
STAGES = (
    "raw",
    "originated_purchase_owner_occupied",
    "nonmissing_lien_status",
    "valid_geography",
    "positive_income_and_loan_amount",
    "valid_loan_type",
    "matched_fhfa_balanced",
    "finite_model_features",
)

# Inputs that are numbers.
NUMERIC_INPUTS = (
    "year",
    "action_taken",
    "loan_purp",
    "occupancy",
    "lien_status",
    "state_code",
    "county_code",
    "app_income",
    "loan_amt",
    "loan_type",
    "purchaser_type",
    "edit_status",
)

# Columns of a clean record, and those read for one.
BASE_COLUMNS = (
    "year",
    "agency_code",
    "loan_type",
    "loan_amt",
    "app_income",
    "purchaser_type",
    "edit_status",
    "state_code",
    "county_code",
    "lien_status",
    "resp_id",
    "seq_num",
)
INPUT_COLUMNS = ("year", "action_taken", "loan_purp", "occupancy", *BASE_COLUMNS[1:])


def _levels() -> dict[str, tuple[int, ...]]:
    return {"purchaser_type": tuple(range(10)), "loan_type": (1, 2, 3, 4)}


@dataclass(frozen=True)
class Domain:
    """Column roles and codes of one partly labelled record table.

    Fixed values: the defaults are the codes, states and years of the declared study.
    """

    label: str = "lien_status"
    negative_class: int = 1
    positive_class: int = 2
    continuous: tuple[str, ...] = ("log_lti", "log_county_value_to_loan")
    restricted_continuous: tuple[str, ...] = ("log_lti",)
    categories: Mapping[str, tuple[int, ...]] = field(default_factory=_levels)
    region_column: str = "state_code"
    excluded_states: tuple[int, ...] = (3, 7, 14, 43, 52)
    first_labelled_year: int = 2004
    train_years: tuple[int, ...] = (2004, 2005, 2006, 2007)
    validate_years: tuple[int, ...] = tuple(range(2008, 2017))
    apply_years: tuple[int, ...] = tuple(range(1990, 2017))

    def inputs(self, feature_set: str) -> tuple[str, ...]:
        """Continuous model inputs of a feature set."""
        if feature_set == "core":
            return self.continuous
        if feature_set == "restricted":
            return self.restricted_continuous
        raise ValueError(f"Unknown feature set {feature_set!r}")


DEFAULT = Domain()
