"""Contact cards derived from ``customer`` keys.

The given prose holds no labelled names, dates of birth, organizations or
addresses.  This view makes one card per customer row, so its size follows the
table.  The SQL uses only functions that Spark and other engines share.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from quietmark.session import save_stage
from quietmark.sources.tables import spread, table

FIRST = ("Asha", "Ravi", "Meera", "Kiran", "Tomas", "Greta", "Liam", "Zoya", "Omar", "Nila", "Priya", "Nilam")
LAST = ("Varma", "Iyer", "Kale", "Rao", "Lind", "Novak", "O'Neil", "Mehra-Das", "Khan", "Nair", "Sharma")

CARD_ID_BASE = 1_000_000_000


def _pick(key: str, values) -> str:
    cases = " ".join(
        "WHEN {} THEN '{}'".format(i, v.replace("'", "''" if "'" in v else "'")) for i, v in enumerate(values)
    )
    return f"CASE ({key}) % {len(values)} {cases} END"


def _digits(key: str, factor: int, width: int) -> str:
    return f"lpad(CAST(({key} * {factor} + 12345) % {10**width} AS STRING), {width}, '0')"


def _luhn_sum(text: str) -> str:
    def term(i: int) -> str:
        d = f"CAST(substring({text}, {i}, 1) AS INT)"
        return f"({d} * 2 - CASE WHEN {d} > 4 THEN 9 ELSE 0 END)" if i % 2 else d

    return " + ".join(term(i) for i in range(1, 16))


def cards_sql(customer: str = "customer") -> str:
    """``doc_id, text`` for every customer, as one SELECT."""
    seven, four = _digits("k", 7_919, 7), _digits("k", 37, 4)
    pin = "concat('4', lpad(CAST((k * 13) % 100000 AS STRING), 5, '0'))"
    first, last = _pick("k", FIRST), _pick("k + CAST(floor(k / 12) AS BIGINT)", LAST)
    month = _pick("k", ("January", "March", "June", "October", "December"))
    day, year = "CAST(1 + k % 28 AS STRING)", "CAST(1940 + k % 60 AS STRING)"
    parts = [
        # name, last on some cards so that white space after it may be crossed
        f"CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN concat('Name: ', f, ' B. ', l, chr(10)) WHEN 2 THEN concat('full name : ', lower(f), ' ', l, ' Director', chr(10)) WHEN 3 THEN concat('Name: Bid Amount', chr(10)) ELSE concat('Full Name: ', f, ' ', l, chr(10)) END",
        f"CASE k % 4 WHEN 0 THEN concat('Organization: ', l, ' Trading Ltd', chr(10)) WHEN 1 THEN concat('organization : ', l, ' & Sons  ', chr(10)) WHEN 2 THEN concat('Organization: Example Organization 4', chr(10)) ELSE '' END",
        f"CASE k % 8 WHEN 0 THEN concat('DOB: ', {day}, '/', CAST(1 + k % 12 AS STRING), '/', {year}) WHEN 1 THEN concat('Date of Birth - ', {day}, ' ', {month}, ' ', {year}) WHEN 2 THEN concat('born on ', {month}, ' ', {day}, ', ', {year}) WHEN 3 THEN concat('Birth date: ', {day}, '-', CAST(1 + k % 12 AS STRING), '-', {year}) WHEN 4 THEN 'DOB: unknown' ELSE concat('joined ', {day}, ' ', {month}, ' ', {year}) END, chr(10)",
        f"'SSN ', substring({seven}, 1, 3), '-', substring({seven}, 4, 2), '-', {four}, chr(10)",
        f"CASE k % 5 WHEN 0 THEN concat('Registered Office: ', CAST(k % 90 AS STRING), ' Lake Road, Pune ', {pin}) WHEN 1 THEN concat('Mailing Address : Plot ', CAST(k % 90 AS STRING), ', ', repeat('far away ', 60), 'Lake Road ', {pin}) WHEN 2 THEN concat('Corporate Address: Box ', {pin}) WHEN 3 THEN concat('Office Address: ', CAST(k % 90 AS STRING), ' Mill Street, Oldtown  ') ELSE concat('Residential Address: Flat ', CAST(k % 30 AS STRING), ', Hill Tower, Mumbai ', {pin}) END, chr(10)",
        f"'Email: ', CASE WHEN k % 3 = 0 THEN 'Help@mail.test' ELSE concat(lower(f), '.', CAST(k AS STRING), '@mail.test') END, chr(10)",
        f"CASE k % 7 WHEN 0 THEN concat('Phone: +91 9', {seven}, '0', CAST(k % 9 AS STRING)) WHEN 1 THEN concat('Tel +1 (212) 5', substring({four}, 1, 2), '-', {four}) WHEN 2 THEN concat('Mobile 0', '98', {four}, {four}) WHEN 3 THEN concat('fax: 919', {seven}, '11') WHEN 4 THEN concat('ref ', {seven}, ' 000') WHEN 5 THEN 'Phone: +91 98765 43210' ELSE concat('(020) 255-', {four}, '-', {four}) END, chr(10)",
        f"'Card: ', substring(b, 1, 4), s, substring(b, 5, 4), s, substring(b, 9, 4), s, substring(b, 13, 3), CAST((10 - ({_luhn_sum('b')}) % 10 + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) % 10 AS STRING), chr(10)",
        "CASE k % 9 WHEN 0 THEN concat('Host 10.1.', CAST(k % 256 AS STRING), '.7', chr(10)) WHEN 1 THEN concat('Host 010.001.', CAST(k % 400 AS STRING), '.9', chr(10)) WHEN 2 THEN concat('was person', CAST(k AS STRING), '@example.com and Person ', CAST(k AS STRING), chr(10)) ELSE '' END",
        "CASE k % 11 WHEN 0 THEN concat('Seen by NILAM VARDEN, Asha Varma Iyer', chr(10)) WHEN 1 THEN concat('xPriya Nair and Priya Nair.', chr(10)) WHEN 2 THEN concat('cc tomas b. lind, Person 3', chr(10)) ELSE '' END",
        f"CASE WHEN k % 6 = 0 THEN concat('Name: ', f, ' ', l, chr(10), 'Email') ELSE 'End of card' END",
    ]
    return f"""
SELECT CAST({CARD_ID_BASE} + k AS BIGINT) AS doc_id, concat({", ".join(parts)}) AS text
FROM (
  SELECT k, {first} AS f, {last} AS l,
         concat('4539', lpad(CAST((k * 104729 + 777) % 100000000000 AS STRING), 11, '0')) AS b,
         CASE k % 3 WHEN 0 THEN '-' WHEN 1 THEN ' ' ELSE '' END AS s
  FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM {customer}) keys
) named
"""


def name_list_sql(customer: str = "customer", supplier: str = "supplier") -> str:
    """``list, name``: thousands of names from the keys of two tables, some of which stand on the cards."""
    first, last = _pick("k", FIRST), _pick("k + CAST(floor(k / 12) AS BIGINT)", LAST)
    return f"""
SELECT 'explicit' AS list, concat(f, ' ', l) AS name FROM (SELECT {first} AS f, {last} AS l FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM {customer}) a) b
UNION SELECT 'known' AS list, concat(f, ' ', chr(CAST(65 + k % 26 AS INT)), '. ', l) AS name
FROM (SELECT k, {first} AS f, {last} AS l FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM {customer} UNION SELECT CAST(s_suppkey * 31 AS BIGINT) AS k FROM {supplier}) c) d
"""


def contact_cards(spark: SparkSession, folder: str) -> DataFrame:
    """The cards as a written table.

    Written, because the long SQL would otherwise be repeated inside every
    pattern filter that Catalyst pushes down to it; once per session and folder.
    """
    return _written(spark, spark.sparkContext.applicationId, folder)


@lru_cache(maxsize=8)
def _written(spark: SparkSession, app: str, folder: str) -> DataFrame:
    keys = spread(table(spark, folder, "customer").select("c_custkey"), "c_custkey")
    return save_stage(spark.sql(cards_sql("{customer}"), customer=keys))
