"""Numbering plan and phone validity.

The plan is a documented approximation of public numbering rules, not a
complete metadata set: country code, length of the national number, pattern of
its leading digits.  Countries without a precise rule are accepted in the
international form with 7 to 12 national digits.  The plan is fixed, so it is
compiled into one regular expression and checked without a join;
``numbering_plan`` is the same as a table for joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietmark.functions.patterns import PHONE_CONTEXT
from quietmark.functions.text import digits

DEFAULT_COUNTRY = "91"

# (country code, label, shortest, longest national number, leading digits)
PRECISE_PLAN = (
    ("91", "IN mobile", 10, 10, "[6-9]"),
    ("91", "IN landline", 10, 10, "[1-5]"),
    ("91", "IN toll-free", 10, 13, "1800"),
    ("1", "NANP", 10, 10, "[2-9][0-9]{2}[2-9]"),
    ("44", "GB", 10, 10, "[1-37]"),
    ("33", "FR", 9, 9, "[1-9]"),
    ("34", "ES", 9, 9, "[6-9]"),
    ("49", "DE", 9, 11, "[1-9]"),
)
# Country codes of one or two digits without a precise rule, and the
# assigned three-digit codes as first two digits and the third digits that follow.
SHORT_CODES = (
    "7 20 27 30 31 32 36 39 40 41 43 45 46 47 48 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 92 93 94 95 98"
).split()
LONG_CODES = {
    "21": "12368", "22": "0123456789", "23": "0123456789", "24": "0123456789", "25": "012345678", "26": "0123456789", "29": "01789",
    "35": "0123456789", "37": "012345678", "38": "01235679", "42": "013", "50": "0123456789", "59": "0123456789", "67": "023456789",
    "68": "012356789", "69": "012", "80": "08", "85": "02356", "87": "08", "88": "012368", "96": "012345678", "97": "012345679", "99": "234568",
}
WORLD_PLAN = tuple((cc, f"+{cc}", 7, 12, "[0-9]") for cc in [*SHORT_CODES, *(start + d for start, ends in LONG_CODES.items() for d in ends)])
NUMBERING_PLAN = PRECISE_PLAN + WORLD_PLAN
PLAN_COLUMNS = ("country_code", "label", "nsn_min", "nsn_max", "lead")


def numbering_plan(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [row for row in NUMBERING_PLAN],
        "country_code string, label string, nsn_min int, nsn_max int, lead string",
    )


def plan_regex(plan=NUMBERING_PLAN, country: str | None = None) -> str:
    """Full-match regex over international digits, or over national ones of ``country``."""
    by_rule: dict[str, list[str]] = {}
    for cc, _, lo, hi, lead in plan:
        if country in (None, cc):
            by_rule.setdefault(f"(?={lead})[0-9]{{{lo},{hi}}}", []).append(cc if country is None else "")
    rows = [f"(?:{'|'.join(codes)}){rule}" for rule, codes in by_rule.items()]
    return f"^(?:{'|'.join(rows)})$"


def international(value: Column, default_country: str = DEFAULT_COUNTRY, plan=NUMBERING_PLAN) -> Column:
    """Digits with country code when the plan accepts the number, else NULL.

    A leading ``+`` or ``00`` marks an international number.  Otherwise the
    number is national: one leading 0 (trunk prefix) is dropped, and a written
    country code is accepted when the number is not national as it stands.
    """
    d = digits(value)
    national = F.regexp_replace(d, "^0", "")
    world, home = plan_regex(plan), plan_regex(plan, default_country)
    return (
        F.when(value.rlike(r"^\s*\+"), F.when(d.rlike(world), d))
        .when(d.startswith("00"), F.when(F.substr(d, F.lit(3)).rlike(world), F.substr(d, F.lit(3))))
        .when(national.rlike(home), F.concat(F.lit(default_country), national))
        .when(d.startswith(default_country) & d.rlike(world), d)
    )


def valid_phone(
    value: Column,
    min_digits: int = 10,
    max_digits: int | None = 13,
    default_country: str = DEFAULT_COUNTRY,
    plan=NUMBERING_PLAN,
) -> Column:
    n = F.length(digits(value))
    in_range = n >= min_digits if max_digits is None else n.between(min_digits, max_digits)
    return F.when(in_range, international(value, default_country, plan).isNotNull()).otherwise(False)


def likely_phone(value: Column, context: Column, plan=NUMBERING_PLAN) -> Column:
    """Inventory rule: valid, or 10-13 digits in a chunk that talks about phones."""
    d = digits(value)
    return (
        F.when((F.length(d) < 7) | d.startswith("000") | d.rlike("^0+$"), False)
        .when(valid_phone(value, 7, None, plan=plan), True)
        .otherwise(context.rlike(PHONE_CONTEXT) & F.length(d).between(10, 13))
    )
