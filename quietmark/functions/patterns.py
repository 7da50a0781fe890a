"""Regular expressions of every detector.

Spark runs them with Java's engine: ``(?U)`` gives Unicode ``\\d \\s \\b`` and
``(?i)`` case-insensitive matching.  No pattern can match the empty string.
"""

# ---------------------------------------------------------------------------
# What each detector accepts.  Results depend on them exactly.
# ---------------------------------------------------------------------------

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"

EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?U)\b(?:{OCTET}\.){{3}}{OCTET}\b"
IP_LOOSE = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"

CARD = r"(?U)\b(?:\d{4}[- ]?){3}\d{4}\b"
CARD_LOOSE = r"(?U)\b(?:\d[ -]*?){13,19}\b"

SSN = r"(?U)\b\d{3}-\d{2}-\d{4}\b"

NUMERIC_DATE = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
DAY_MONTH_YEAR = rf"\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}"
MONTH_DAY_YEAR = rf"(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}"
BIRTH_DATE = (
    r"(?iU)(?:date\s+of\s+birth|dob|d\.o\.b\.|born\s+on)\s*[:\-]?\s*"
    rf"(?:{NUMERIC_DATE}|{DAY_MONTH_YEAR}|{MONTH_DAY_YEAR})"
)
BIRTH_DATE_LOOSE = (
    r"(?iU)(?:date\s+of\s+birth|dob|born\s+on|birth\s+date)[:\s-]{0,20}"
    rf"({NUMERIC_DATE}|{DAY_MONTH_YEAR})"
)

PHONE = r"(?U)(?<!\d)\+?\d[\d\s().-]{8,}\d(?!\d)"
PHONE_LOOSE = (
    r"(?U)(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{2,5}\)|\d{2,5})[\s.-]\d{3,4}[\s.-]\d{3,4}"
    r"|\+?\d{10,13}"
)
PHONE_CONTEXT = r"(?iU)telephone|phone|mobile|contact\s*(?:no|number)?|tel|fax"
DIGIT_RUN = r"(?U)\d{10,13}"

PIN = r"(?U)\b\d{6}\b"

# The gap between the words of a labelled name may be any white space; the
# line-bound variant keeps the name on the line of its label.
NAME_WORD = r"[A-Z][A-Za-z'-]+"
NAME_NEXT_WORD = r"[A-Z][A-Za-z'.-]+"
LABELLED_NAME = rf"(?iU)\b(?:name|full\s+name)\s*:\s*({NAME_WORD}(?:\s+{NAME_NEXT_WORD})+)"
LABELLED_NAME_LINE = (
    rf"(?iU)\b(?:name|full[ \t]+name)[ \t]*:[ \t]*({NAME_WORD}(?:[ \t]+{NAME_NEXT_WORD})+)"
)
LABELLED_ORGANIZATION = r"(?iU)\borganization\s*:\s*([^\n]+)"
LABELLED_ADDRESS = (
    r"(?iU)\b(?:residential\s+address|office\s+address|home\s+address|work\s+address)\s*:\s*([^\n]+)"
)

ADDRESS_LABEL = (
    r"(?iU)(?:registered\s+office|corporate\s+office|registered\s+address|corporate\s+address"
    r"|mailing\s+address|residential\s+address|correspondence\s+address)\s*:"
)
ADDRESS_WINDOW = 500
ADDRESS_COMPONENT = (
    r"(?iU)village|road|street|lane|tower|building|apartment|floor|taluka|district"
    r"|industrial\s+area|nagar|farms|chakan|pune|mumbai|maharashtra|marg|complex|society|colony"
)
ADDRESS_CONTEXT = (
    r"(?iU)registered\s+office|corporate\s+office|registered\s+address|corporate\s+address"
    r"|mailing\s+address|residential\s+address|correspondence\s+address|office\s+address|address"
)

# Placeholder shapes, per type, as counted by the reports and skipped by the
# detectors.
PLACEHOLDER_SHAPES = {
    "email": r"person\d+@example\.com",
    "phone": r"\+91 90000 \d{5}",
    "ip": r"192\.0\.2\.\d+",
    "credit_card": r"4111-1111-1111-\d{4}",
    "ssn": r"000-00-\d{4}",
    "person": r"Person \d+",
    "organization": r"Example Organization \d+",
    "address": r"Example Address \d+",
}

# ---------------------------------------------------------------------------
# Shapes of our own: the full address text, the constant date, the bracket form
# beyond a template's range, and hashed tokens.  The writer of tokens takes its
# letters and length from here.
# ---------------------------------------------------------------------------

TOKEN_LETTERS = "abcdefghijklmnop"
TOKEN_LENGTH = 32

EXTRA_SHAPES = (
    r"Example Address \d+, Pune, Maharashtra 400001",
    r"01 January 1990",
    r"\[[A-Z_]+-\d+\]",
    rf"\[[A-Z_]+-[{TOKEN_LETTERS}]{{{TOKEN_LENGTH}}}\]",
)
