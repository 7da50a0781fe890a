"""Dictionary keys and placeholder texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietmark.functions.patterns import TOKEN_LENGTH, TOKEN_LETTERS
from quietmark.functions.text import digits, strip

# ---------------------------------------------------------------------------
# The nine types, their placeholder texts, and the largest number
# that a bounded text can hold.
# ---------------------------------------------------------------------------

TYPES = ("email", "phone", "ip", "credit_card", "ssn", "dob", "person", "organization", "address")

TEMPLATES = {
    "email": "person%d@example.com",
    "phone": "+91 90000 %05d",
    "ip": "192.0.2.%d",
    "credit_card": "4111-1111-1111-%04d",
    "ssn": "000-00-%04d",
    "dob": "01 January 1990",
    "person": "Person %d",
    "organization": "Example Organization %d",
    "address": "Example Address %d, Pune, Maharashtra 400001",
}

LARGEST = {"phone": 99_999, "ip": 255, "credit_card": 9_999, "ssn": 9_999}


def norm_key(kind: Column, value: Column, canonical: bool = False) -> Column:
    """Two values with the same key share a placeholder.

    ``canonical`` also ignores the separators of phones and cards.
    """
    key = F.lower(strip(value))
    return F.when(kind.isin("phone", "credit_card"), digits(value)).otherwise(key) if canonical else key


def placeholder(kind: Column, n: Column, overflow: bool = True) -> Column:
    """Numbered text of a type; past a template's range ``[TYPE-n]``.

    Without ``overflow`` the number just grows wider than its template.
    """
    text = F.lit(None).cast("string")
    for name, template in TEMPLATES.items():
        made = F.format_string(template, n) if "%" in template else F.lit(template)
        if overflow and name in LARGEST:
            made = F.when(n <= LARGEST[name], made).otherwise(F.format_string(f"[{name.upper()}-%d]", n))
        text = F.when(kind == name, made).otherwise(text)
    return text


def hashed_placeholder(kind: Column, key: Column, secret: str) -> Column:
    """Token that depends on type, key and secret only: no dictionary, no order.

    The digest is keyed inside and outside, so a token can neither be guessed by
    hashing all possible values nor extended; its decimal digits are written as
    letters, so no detector takes a part of a token for a number.
    """
    if not secret:
        raise ValueError("a secret is needed: unkeyed digests of short values can be reversed by trying all values")
    inner = F.sha2(F.concat_ws("\u001f", F.lit(f"{secret}.inner"), kind, key), 256)
    digest = F.translate(F.sha2(F.concat_ws("\u001f", F.lit(f"{secret}.outer"), inner), 256), "0123456789", TOKEN_LETTERS[6:])
    token = F.concat(F.lit("["), F.upper(kind), F.lit("-"), F.substring(digest, 1, TOKEN_LENGTH), F.lit("]"))
    return F.when(kind == "dob", F.lit(TEMPLATES["dob"])).otherwise(token)
