"""Accept and reject tables for the value rules."""

import pytest
from pyspark.sql import functions as F

from quietmark.functions.phones import international, likely_phone, valid_phone
from quietmark.functions.placeholders import TYPES, hashed_placeholder, norm_key, placeholder
from quietmark.functions.predicates import (
    address_score,
    clean_person,
    is_organization,
    is_placeholder,
    looks_like_person,
    luhn_valid,
    valid_ip,
)


def check(spark, rule, cases):
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "value string, expected string")
    got = {r["value"]: r["got"] for r in df.select("value", rule(F.col("value")).alias("got")).collect()}
    assert got == cases


def flags(accept, reject):
    return {v: True for v in accept} | {v: False for v in reject}


def run_flags(spark, rule, accept, reject):
    df = spark.createDataFrame([(v,) for v in [*accept, *reject]], "value string")
    got = {r["value"]: r["got"] for r in df.select("value", rule(F.col("value")).alias("got")).collect()}
    assert got == flags(accept, reject)


def test_luhn(spark):
    run_flags(
        spark,
        luhn_valid,
        ["4111-1111-1111-1111", "4111 1111 1111 1111", "378282246310005", "6011000990139424"],
        ["4111-1111-1111-1112", "1234567812345678", "42", "", "0" * 20],
    )


def test_placeholders(spark):
    run_flags(
        spark,
        is_placeholder,
        [
            "Person 1", "Person 44", "person 7", " Person 3 ", "person1@example.com", "+91 90000 00001", "192.0.2.9",
            "4111-1111-1111-0001", "000-00-0001", "Example Organization 1", "Example Address 1",
            "Example Address 12, Pune, Maharashtra 400001", "01 January 1990", "[IP-256]", "[PHONE-100000]",
        ],
        ["Person", "Person one", "Person 1 Smith", "someone@example.com", "192.0.3.1", ""],
    )
    run_flags(
        spark,
        lambda v: is_placeholder(v, extended=False),
        ["Person 1", "Example Address 1"],
        ["Example Address 12, Pune, Maharashtra 400001", "01 January 1990", "[IP-256]"],
    )


def test_names(spark):
    run_flags(
        spark,
        looks_like_person,
        ["Asha Kiran Varma", "Tomas B. Lind", "Liam O'Neil", "Zoya Mehra-Das", "Nilam Varden, Director"],
        ["Bid Amount", "Person 1", "Asha", "Lake Road", "Hill House Society", "", "Model Colony", "12 34", "Acme Trading Ltd"],
    )


def test_clean_person(spark):
    check(
        spark,
        clean_person,
        {
            " Asha  Varma ": "Asha Varma",
            "(Asha Varma), ": "Asha Varma",
            "Asha Varma Director Email": "Asha Varma",
            "Director": "",
            "Asha\nVarma Company:": "Asha Varma",
            "": "",
        },
    )


def test_phones(spark):
    run_flags(
        spark,
        valid_phone,
        ["+91 9876543210", "9876543210", "09876543210", "919876543210", "+1 (212) 555-0123", "020 2551 2345"],
        ["12345", "+1 (112) 555-0123", "0000000000", "+999 12345678", "12345678901234", "4111111111111111"],
    )
    check(
        spark,
        international,
        {"09876543210": "919876543210", "+1 212 555 0123": "12125550123", "0044 20 7946 0958": "442079460958", "+7 1": None},
    )


@pytest.mark.parametrize(
    "value,context,expected",
    [
        ("123456", "phone", False),
        ("0000000000", "phone", False),
        ("000 1234 567", "phone", False),
        ("98765 43210", "", True),
        ("1112 223 334", "", True),
        ("1111 222 333 4", "", False),
        ("0123 456 7890 12", "no hint", False),
        ("0123 456 7890 12", "hotel", True),
        ("123 4567", "tel", False),
    ],
)
def test_likely_phone(spark, value, context, expected):
    df = spark.createDataFrame([(value, context)], "v string, c string")
    assert df.select(likely_phone(F.col("v"), F.col("c"))).first()[0] is expected


def test_ip(spark):
    run_flags(spark, valid_ip, ["1.2.3.4", "010.001.1.9", "255.255.255.255"], ["256.1.1.1", "1.2.3", "1.2.3.4.5"])


def test_organizations(spark):
    run_flags(
        spark,
        is_organization,
        ["Lind Trading Ltd", "First Bank of Oldtown", "SECURITIES house", "Trusted Parts"],
        ["Company", " bank ", "Lind and Sons", ""],
    )


def test_address_score(spark):
    text = "near Lake Road, 3rd floor, Hill Building, Asha Varma, Pune district road"
    at = text.index("Asha")
    df = spark.createDataFrame([(text, at, at + 10)], "t string, s int, e int")
    assert df.select(address_score(F.col("t"), F.col("s"), F.col("e"))).first()[0] == 5


def test_placeholder_text(spark):
    df = spark.createDataFrame([(t,) for t in TYPES], "type string")
    text = lambda n, **kw: {r[0]: r[1] for r in df.select("type", placeholder(F.col("type"), F.lit(n), **kw)).collect()}
    assert text(7)["phone"] == "+91 90000 00007"
    assert text(7)["address"] == "Example Address 7, Pune, Maharashtra 400001"
    assert text(256)["ip"] == "[IP-256]" and text(255)["ip"] == "192.0.2.255"
    assert text(256, overflow=False)["ip"] == "192.0.2.256"
    assert text(10_000)["ssn"] == "[SSN-10000]" and text(100_000)["phone"] == "[PHONE-100000]"
    assert text(1)["dob"] == text(2)["dob"]
    for n in (1, 255, 256, 10_000, 100_000):
        made = df.select(placeholder(F.col("type"), F.lit(n)).alias("p"))
        assert made.where(~is_placeholder(F.col("p"))).count() == 0


def test_keys(spark):
    df = spark.createDataFrame([("email", " A@B.Com "), ("phone", "+91 98 1")], "t string, v string")
    assert [r[0] for r in df.select(norm_key(F.col("t"), F.col("v"))).collect()] == ["a@b.com", "+91 98 1"]
    assert [r[0] for r in df.select(norm_key(F.col("t"), F.col("v"), True)).collect()] == ["a@b.com", "91981"]
    a, b, c = df.select(
        hashed_placeholder(F.lit("email"), F.lit("x"), "s"),
        hashed_placeholder(F.lit("email"), F.lit("x"), "t"),
        hashed_placeholder(F.lit("ssn"), F.lit("x"), "s"),
    ).first()
    assert len({a, b, c}) == 3 and a.startswith("[EMAIL-")


def test_numbers_of_many_countries(spark):
    good = ["+61 2 9374 4000", "+81 3-6384-9000", "+971 4 450 9500", "+65 6521 8000", "+55 11 2395-8400", "+39 06 6982 1234", "+7 495 123 45 67",
            "0041 44 668 18 00", "+353 1 436 1000", "+420 212 345 678", "+91 98765 43210", "+1 212 555 0100"]
    bad = ["+999999", "+210 12", "+1 112 555 0100", "+44 0000000000", "+28 123456789", "12345"]
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    assert [r[0] for r in df.select(valid_phone(F.col("v"))).collect()] == [True] * len(good) + [False] * len(bad)
