"""The same queries as SQL for an independent engine.

Written from the definitions, not from the Spark plans: other regular
expressions where look-around is missing, windows instead of folds, plain
``row_number`` instead of range-partitioned numbering.
"""

from __future__ import annotations

from html.entities import html5

from quietmark.functions import patterns as P
from quietmark.functions import vocab as V
from quietmark.functions.phones import DEFAULT_COUNTRY, NUMBERING_PLAN
from quietmark.plans.queries import NAMES, SECRET, TURN_ID_BASE
from quietmark.sources.cards import CARD_ID_BASE, cards_sql, name_list_sql
from quietmark.sources.chunks import BLOCK_TAGS, FORMAT_TAGS, HIDDEN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    """RE2 form: classes are ASCII there, so the Unicode flag goes."""
    return q(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""))


def array(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def strip(v: str) -> str:
    return f"regexp_replace({v}, '^\\s+|\\s+$', '', 'g')"


def digits(v: str) -> str:
    return f"regexp_replace({v}, '\\D', '', 'g')"


PHONE_RE2 = r"(^|\D)(\+?\d[\d\s().-]{8,}\d)"

CORPUS = f"""
SELECT doc_id, text FROM documents
UNION ALL SELECT {TURN_ID_BASE} + conv_id * 1000 + turn, text FROM conversations
UNION ALL {cards_sql()}
"""
BASE = f"corpus AS MATERIALIZED ({CORPUS})"
CELLS = r"chunks AS (SELECT doc_id, 1 AS chunk_no, text FROM corpus WHERE regexp_matches(text, '\S'))"


def line_chunks(source: str = "corpus", name: str = "chunks") -> str:
    return rf"""{name} AS (
  SELECT doc_id, i AS chunk_no, parts[i] AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {source}), unnest(range(1, len(parts) + 1)) t(i)
  WHERE regexp_matches(parts[i], '\S'))"""


FIELDS = rf"""fields AS (
  SELECT doc_id, 2 * (i - 1) + c AS chunk_no, 1 AS table_no, i AS row_no, c AS col_no,
         CASE WHEN c = 1 THEN substring(parts[i], 1, cut) ELSE substring(parts[i], cut + 1) END AS text
  FROM (SELECT doc_id, parts, i, CASE WHEN contains(parts[i], ':') THEN strpos(parts[i], ':') ELSE length(parts[i]) END AS cut
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM ({cards_sql()}) x), unnest(range(1, len(parts) + 1)) t(i)),
       unnest([1, 2]) u(c)
  WHERE regexp_matches(CASE WHEN c = 1 THEN substring(parts[i], 1, cut) ELSE substring(parts[i], cut + 1) END, '\S'))"""


def luhn(v: str) -> str:
    d = digits(v)
    total = (
        f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: "
        f"CASE WHEN (length({d}) - i) % 2 = 1 THEN CAST(substring({d}, i, 1) AS INT) * 2 "
        f"- CASE WHEN CAST(substring({d}, i, 1) AS INT) > 4 THEN 9 ELSE 0 END "
        f"ELSE CAST(substring({d}, i, 1) AS INT) END))"
    )
    return f"(length({d}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"


def in_plan(d: str, country: str | None = None) -> str:
    tests, alike = [], {}
    for cc, _, lo, hi, lead in NUMBERING_PLAN:
        if country is None:
            alike.setdefault((len(cc), lo, hi, lead), []).append(q(cc))
        elif cc == country:
            tests.append(f"(length({d}) BETWEEN {lo} AND {hi} AND regexp_matches({d}, '^(?:{lead})'))")
    for (k, lo, hi, lead), codes in alike.items():
        tests.append(
            f"(substring({d}, 1, {k}) IN ({', '.join(codes)}) AND length({d}) - {k} BETWEEN {lo} AND {hi} AND regexp_matches(substring({d}, {k + 1}), '^(?:{lead})'))"
        )
    return "(" + " OR ".join(tests) + ")"


def e164(v: str) -> str:
    d = digits(v)
    home = f"regexp_replace({d}, '^0', '')"
    return (
        f"CASE WHEN starts_with(trim({v}), '+') THEN CASE WHEN {in_plan(d)} THEN {d} END "
        f"WHEN starts_with({d}, '00') THEN CASE WHEN {in_plan(f'substring({d}, 3)')} THEN substring({d}, 3) END "
        f"WHEN {in_plan(home, DEFAULT_COUNTRY)} THEN '{DEFAULT_COUNTRY}' || {home} "
        f"WHEN starts_with({d}, '{DEFAULT_COUNTRY}') AND {in_plan(d)} THEN {d} END"
    )


def valid_phone(v: str, lo: int = 10, hi: int | None = 13) -> str:
    upper = "" if hi is None else f" AND length({digits(v)}) <= {hi}"
    return f"(length({digits(v)}) >= {lo}{upper} AND ({e164(v)}) IS NOT NULL)"


def is_placeholder(v: str, extended: bool = False) -> str:
    shapes = list(P.PLACEHOLDER_SHAPES.values()) + (list(P.EXTRA_SHAPES) if extended else [])
    return f"regexp_matches({strip(v)}, {q('(?i)^(?:' + '|'.join(shapes) + ')$')})"


EDGE_RE2 = r"^[ /,:;.\-*^&()\[\]{}]+|[ /,:;.\-*^&()\[\]{}]+$"


def words_of(v: str) -> str:
    return f"list_filter(regexp_split_to_array({v}, '\\s+'), lambda w: w <> '')"


def clean(v: str) -> str:
    words = words_of(f"regexp_replace({strip(v)}, {q(EDGE_RE2)}, '', 'g')")
    keep = (
        f"coalesce(list_max(list_transform({words}, lambda w, i: "
        f"CASE WHEN list_contains({array(V.GENERIC_WORDS)}, regexp_replace(lower(w), {q(EDGE_RE2)}, '', 'g')) THEN 0 ELSE i END)), 0)"
    )
    return f"coalesce(array_to_string(({words})[1:{keep}], ' '), '')"


def person(v: str) -> str:
    """Name test over an already cleaned value."""
    lettered = f"list_filter(list_transform({words_of(v)}, lambda w: regexp_replace(w, '[^A-Za-z''-]', '', 'g')), lambda w: w <> '')"
    banned = array(sorted(set(V.NON_PERSON_WORDS) | set(V.GENERIC_WORDS)))
    return (
        f"(len({words_of(v)}) >= 2 AND len({lettered}) >= 2 "
        f"AND NOT list_has_any(list_transform({lettered}, lambda w: lower(w)), {banned}) "
        f"AND len(list_filter({lettered}, lambda w: NOT regexp_full_match(w, '[A-Za-z][A-Za-z''-]*'))) = 0)"
    )


def raw_spans(pattern: str, group: int = 0, source: str = "chunks", extra: str = "") -> str:
    """doc_id, chunk_no, text, st, en, value of every match; offsets by summed lengths."""
    p = pattern if pattern.startswith("'") else rx(pattern)
    return f"""
  SELECT doc_id, chunk_no, text, en - length(v[i]) AS st, en, v[i] AS value FROM (
    SELECT *, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT) AS en
    FROM (SELECT doc_id, chunk_no, text, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {group}) AS v,
                 regexp_split_to_array(text, {p}) AS g
          FROM {source} WHERE regexp_matches(text, {p}) {extra}) h, unnest(range(1, len(m) + 1)) t(i)) s"""


def listed_spans(names, rank: int) -> str:
    """Bounded occurrences of each name, found one name at a time."""
    parts = []
    for n in names:
        quoted = n.replace(".", r"\.")
        # No look-around: take the neighbours along, then drop them again.
        # Double separators so that one neighbour is not shared by two matches.
        pattern = rf"(?i)(^|[^A-Za-z])({quoted})($|[^A-Za-z])"
        parts.append(
            f"SELECT doc_id, chunk_no, text, en - length(tail) - length(core) AS st, en - length(tail) AS en, core AS value, {rank} AS rk, 'person' AS type FROM ("
            f"SELECT doc_id, chunk_no, text, en, regexp_extract(value, {q(pattern)}, 2) AS core, regexp_extract(value, {q(pattern)}, 3) AS tail "
            f"FROM ({raw_spans(pattern)}) a) b"
        )
    return "\nUNION ALL ".join(parts)


def detector_sql(name: str, strict: bool = False, luhn_check: bool = True) -> str:
    """doc_id, chunk_no, text, st, en, value, rk, type of one detector."""

    def simple(pattern, rank, kind, keep="TRUE"):
        return f"SELECT doc_id, chunk_no, text, st, en, value, {rank} AS rk, '{kind}' AS type FROM ({raw_spans(pattern)}) r WHERE {keep}"

    def labelled(pattern, rank, kind, keep="TRUE"):
        if strict:
            st = "en - length(regexp_replace(raw, '^\\s+', ''))"
            en = "st + length(regexp_replace(raw, '\\s+$', ''))"
        else:
            st, en = "st", "en"
        return (
            f"SELECT doc_id, chunk_no, text, {st} AS st, {en} AS en, value, {rank} AS rk, '{kind}' AS type "
            f"FROM (SELECT * EXCLUDE (value), value AS raw, {strip('value')} AS value FROM ({raw_spans(pattern, 1)}) r) z WHERE value <> '' AND {keep}"
        )

    if name == "labelled_name":
        return labelled(P.LABELLED_NAME_LINE if strict else P.LABELLED_NAME, 1, "person", person(f"({clean('value')})"))
    if name == "email":
        return simple(P.EMAIL, 3, "email")
    if name == "ip":
        return simple(P.IP, 4, "ip")
    if name == "credit_card":
        return simple(P.CARD, 5, "credit_card", luhn("value") if luhn_check else "TRUE")
    if name == "ssn":
        return simple(P.SSN, 6, "ssn")
    if name == "dob":
        return simple(P.BIRTH_DATE, 7, "dob")
    if name == "phone":
        return f"SELECT doc_id, chunk_no, text, st, en, value, 8 AS rk, 'phone' AS type FROM ({raw_spans(PHONE_RE2, 2)}) r WHERE {valid_phone('value')}"
    if name == "labelled_address":
        return labelled(P.LABELLED_ADDRESS, 9, "address")
    if name == "address_window":
        return (
            "SELECT doc_id, chunk_no, text, st, st + upto AS en, substring(text, st + 1, upto) AS value, 10 AS rk, 'address' AS type FROM ("
            f"SELECT *, length(regexp_extract(win, '(?s)^.*?\\b\\d{{6}}\\b')) AS upto FROM ("
            f"SELECT *, substring(text, st + 1, en - st + {P.ADDRESS_WINDOW}) AS win FROM ({raw_spans(P.ADDRESS_LABEL)}) r) w) u "
            f"WHERE upto > 0 AND regexp_matches(win, {rx(P.ADDRESS_COMPONENT)})"
        )
    if name == "labelled_organization":
        return labelled(P.LABELLED_ORGANIZATION, 12, "organization")
    if name == "explicit_names":
        return listed_spans(NAMES["explicit"], 2)
    if name == "known_names":
        return listed_spans(NAMES["known"], 11)
    raise KeyError(name)


DETECTORS = (
    "labelled_name", "email", "ip", "credit_card", "ssn", "dob", "phone", "labelled_address", "address_window",
    "labelled_organization",
)
NAME_LISTS = ("explicit_names", "known_names")


def spans_cte(detectors, strict: bool = False, luhn_check: bool = True, extra: str = "") -> str:
    parts = "\nUNION ALL ".join(f"({detector_sql(n, strict, luhn_check)})" for n in detectors)
    return f"""spans AS MATERIALIZED (
SELECT doc_id, chunk_no, text, st, en, value, rk, type FROM ({parts}) u WHERE st < en AND NOT {is_placeholder('value', strict)} {extra})"""


def spans_query(detector: str, luhn_check: bool = True) -> str:
    return f"""WITH {BASE}, {CELLS}, {spans_cte([detector], luhn_check=luhn_check)}
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(st AS BIGINT) AS start, CAST(en AS BIGINT) AS "end", type, value FROM spans"""


LONGEST = """merged AS MATERIALIZED (
  SELECT doc_id, chunk_no, s.st AS st, s.en AS en, s.rk AS rk, s.type AS type, s.value AS value
  FROM (SELECT doc_id, chunk_no, unnest(list_reduce(
          list_transform(list({'st': st, 'en': en, 'rk': rk, 'type': type, 'value': value} ORDER BY st, st - en, rk), lambda x: [x]),
          lambda kept, x: CASE WHEN x[1].st >= kept[-1].en THEN list_concat(kept, x)
                               WHEN x[1].en - x[1].st > kept[-1].en - kept[-1].st THEN list_concat(kept[1:len(kept) - 1], x)
                               ELSE kept END)) AS s
        FROM spans GROUP BY doc_id, chunk_no) f)"""

COVER = """merged AS MATERIALIZED (
  SELECT doc_id, chunk_no, min(st) AS st, max(en) AS en, first(rk ORDER BY st - en, rk) AS rk,
         first(type ORDER BY st - en, rk) AS type, first(value ORDER BY st - en, rk) AS value
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, chunk_no ORDER BY st, st - en, rk, value ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT *, CASE WHEN st >= max(en) OVER (PARTITION BY doc_id, chunk_no ORDER BY st, st - en, rk, value
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM spans) a) b
  GROUP BY doc_id, chunk_no, run)"""


def numbered_text(kind: str = "type", n: str = "n", overflow: bool = False) -> str:
    def cap(limit, name, text):
        return f"CASE WHEN {n} > {limit} THEN '[{name}-' || {n} || ']' ELSE {text} END" if overflow else text

    return f"""CASE {kind}
    WHEN 'email' THEN 'person' || {n} || '@example.com'
    WHEN 'phone' THEN {cap(99999, 'PHONE', f"'+91 90000 ' || lpad(CAST({n} AS VARCHAR), CAST(greatest(5, length(CAST({n} AS VARCHAR))) AS INT), '0')")}
    WHEN 'ip' THEN {cap(255, 'IP', f"'192.0.2.' || {n}")}
    WHEN 'credit_card' THEN {cap(9999, 'CREDIT_CARD', f"'4111-1111-1111-' || lpad(CAST({n} AS VARCHAR), CAST(greatest(4, length(CAST({n} AS VARCHAR))) AS INT), '0')")}
    WHEN 'ssn' THEN {cap(9999, 'SSN', f"'000-00-' || lpad(CAST({n} AS VARCHAR), CAST(greatest(4, length(CAST({n} AS VARCHAR))) AS INT), '0')")}
    WHEN 'dob' THEN '01 January 1990'
    WHEN 'person' THEN 'Person ' || {n}
    WHEN 'organization' THEN 'Example Organization ' || {n}
    WHEN 'address' THEN 'Example Address ' || {n} || ', Pune, Maharashtra 400001' END"""


def dictionary_cte(scope: str = "corpus", overflow: bool = False) -> str:
    group = "type" if scope == "corpus" else "doc_id, type"
    return f"""keyed AS (SELECT *, lower({strip('value')}) AS norm_key FROM merged),
dictionary AS MATERIALIZED (
  SELECT *, {numbered_text(overflow=overflow)} AS replacement FROM (
    SELECT {group}, norm_key, uses, row_number() OVER (PARTITION BY {group} ORDER BY first) AS n
    FROM (SELECT {group}, norm_key, min({{'d': doc_id, 'c': chunk_no, 's': st}}) AS first, count(*) AS uses FROM keyed GROUP BY {group}, norm_key) x) y)"""


def splice_cte(scope: str = "corpus", replacement: str | None = None) -> str:
    on = "k.type = d.type AND k.norm_key = d.norm_key" + (" AND k.doc_id = d.doc_id" if scope == "document" else "")
    if replacement is None:
        rows = f"SELECT k.doc_id, k.chunk_no, k.st, k.en, k.type, k.value, d.replacement FROM keyed k JOIN dictionary d ON {on}"
    else:
        rows = f"SELECT doc_id, chunk_no, st, en, type, value, {replacement} AS replacement FROM keyed"
    return f"""replaced AS MATERIALIZED ({rows}),
pieces AS (
  SELECT doc_id, chunk_no, string_agg(substring(text, prev + 1, st - prev) || replacement, '' ORDER BY st) AS head, max(en) AS last, count(*) AS n
  FROM (SELECT r.*, c.text, coalesce(lag(r.en) OVER (PARTITION BY r.doc_id, r.chunk_no ORDER BY r.st), 0) AS prev
        FROM replaced r JOIN chunks c ON r.doc_id = c.doc_id AND r.chunk_no = c.chunk_no) x
  GROUP BY doc_id, chunk_no),
redacted AS MATERIALIZED (
  SELECT c.doc_id, c.chunk_no, c.text, CASE WHEN p.n IS NULL THEN c.text ELSE p.head || substring(c.text, p.last + 1) END AS redacted_text,
         coalesce(p.n, 0) AS n_redactions
  FROM chunks c LEFT JOIN pieces p ON c.doc_id = p.doc_id AND c.chunk_no = p.chunk_no)"""


def redacted_ctes(detectors=DETECTORS + NAME_LISTS, chunks: str = CELLS, scope: str = "corpus") -> str:
    return f"{BASE}, {chunks}, {spans_cte(detectors)}, {LONGEST}, {dictionary_cte(scope)}, {splice_cte(scope)}"


CHUNK_COLUMNS = "doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, redacted_text, CAST(n_redactions AS BIGINT) AS n_redactions"

_INNER = f"sha256({q(SECRET + '.inner')} || chr(31) || type || chr(31) || norm_key)"
HASHED = (
    "CASE WHEN type = 'dob' THEN '01 January 1990' ELSE '[' || upper(type) || '-' || "
    f"substring(translate(sha256({q(SECRET + '.outer')} || chr(31) || {_INNER}), '0123456789', 'ghijklmnop'), 1, 32) || ']' END"
)


def hashed_twice_query() -> str:
    """One strict pass: the second one must change nothing."""
    return f"""WITH {BASE}, {line_chunks()}, {spans_cte(DETECTORS + NAME_LISTS, True)}, {COVER},
keyed AS (SELECT *, lower({strip('value')}) AS norm_key FROM merged), {splice_cte(replacement=HASHED)}
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, redacted_text, CAST(n_redactions AS BIGINT) AS first_redactions, CAST(0 AS BIGINT) AS n_redactions FROM redacted"""


def hashed_query(source: str) -> str:
    return f"""WITH {source}, {line_chunks()}, {spans_cte(DETECTORS + NAME_LISTS)}, {LONGEST},
keyed AS (SELECT *, lower({strip('value')}) AS norm_key FROM merged), {splice_cte(replacement=HASHED)}
SELECT {CHUNK_COLUMNS} FROM redacted"""


TITLE_CASE = r"\b[A-Z][A-Za-z'-]+(?: [A-Z][A-Za-z'.-]+)+"


def is_org(v: str) -> str:
    low = f"lower({strip(v)})"
    return (
        "((" + " OR ".join(f"contains({low}, {q(t)})" for t in V.ORGANIZATION_TERMS) + ")"
        f" AND NOT list_contains({array(V.GENERIC_ORGANIZATION_WORDS)}, {low}))"
    )


CANDIDATES = f"""candidates AS MATERIALIZED (
  SELECT doc_id, chunk_no, st AS start, en AS "end", text AS context, value AS text,
         CASE WHEN {is_org('value')} THEN 'ORG' ELSE 'PERSON' END AS label FROM ({raw_spans(TITLE_CASE)}) r)"""
WITH_CANDIDATES = f"WITH {BASE}, {line_chunks()}, {CANDIDATES}"


def with_residuals() -> str:
    """``candidates`` over the redacted text."""
    after = "after AS MATERIALIZED (SELECT doc_id, chunk_no, redacted_text AS text FROM redacted)"
    label = f"CASE WHEN {is_org('value')} THEN 'ORG' ELSE 'PERSON' END"
    return f"WITH {redacted_ctes()}, {after}, candidates AS MATERIALIZED (SELECT value AS text, {label} AS label FROM ({raw_spans(TITLE_CASE, 0, 'after')}) r)"


def people(known: tuple[str, ...] = ()) -> str:
    near = "substring(context, greatest(start - 80, 0) + 1, start - greatest(start - 80, 0)) || ' ' || substring(context, \"end\" + 1, 80)"
    score = f"len(list_intersect(list_distinct(regexp_extract_all(lower({near}), '[a-z]+')), {array(V.ADDRESS_WORDS)}))"
    names = array([k.lower() for k in known]) if known else "CAST([] AS VARCHAR[])"
    # the cleaned value is cleaned again by the name test
    return f"""SELECT doc_id, chunk_no, context, start, "end", value FROM (
  SELECT *, {clean('text')} AS value FROM candidates WHERE label = 'PERSON') c
WHERE (list_contains({names}, lower(value)) OR {person(f"({clean('value')})")})
  AND NOT {is_placeholder('value')} AND {score} < 3"""


ORGS = f"""SELECT doc_id, chunk_no, context, start, "end", value FROM (SELECT *, {strip('text')} AS value FROM candidates WHERE label = 'ORG') c
WHERE {is_org('value')} AND NOT {is_placeholder('value')}"""


def values_sql(source: str, text: str, luhn_check: bool, hi: int | None = 13, lower_email: bool = True) -> str:
    def each(kind, pattern, group=0, keep="TRUE", value="v"):
        return (
            f"SELECT doc_id, '{kind}' AS type, {value} AS value FROM (SELECT doc_id, unnest(regexp_extract_all({text}, {rx(pattern)}, {group})) AS v FROM {source}) t WHERE {keep}"
        )

    return "\nUNION ".join(
        [
            each("email", P.EMAIL, value="lower(v)" if lower_email else "v"),
            each("phone", PHONE_RE2, 2, valid_phone("v", 10, hi)),
            each("ip", P.IP),
            each("credit_card", P.CARD, keep=luhn("v") if luhn_check else "TRUE"),
            each("ssn", P.SSN),
        ]
    )


def survivors_cte(luhn_check: bool, exact: bool) -> str:
    if exact:
        special = r"([.+()\-\[\]])"
        hit = f"regexp_matches(r.redacted_text, '(?i)(^|[^\\pL\\pN])' || regexp_replace(o.value, {q(special)}, '\\\\\\1', 'g') || '($|[^\\pL\\pN])')"
    else:
        hit = "contains(lower(r.redacted_text), lower(o.value))"
    return f"""originals AS MATERIALIZED ({values_sql('chunks', 'text', luhn_check)}),
survivors AS (
  SELECT o.doc_id, o.type, o.value,
         {hit} OR (o.type = 'phone' AND list_contains(regexp_extract_all(r.redacted_text, '\\d{{10,13}}'), {digits('o.value')})) AS survived
  FROM originals o JOIN redacted r ON o.doc_id = r.doc_id)"""


def survival_query(luhn_check: bool, exact: bool) -> str:
    kinds = "(VALUES ('email'), ('phone'), ('ip'), ('credit_card'), ('ssn'), ('total')) k(type)"
    return f"""WITH {redacted_ctes()}, {survivors_cte(luhn_check, exact)}
SELECT k.type, count(s.type) AS original, count(*) FILTER (WHERE s.survived) AS survived,
       CASE WHEN count(*) FILTER (WHERE s.survived) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM {kinds} LEFT JOIN survivors s ON k.type = s.type OR k.type = 'total' GROUP BY k.type"""


def residuals_query() -> str:
    own = " OR ".join(f"(type = '{t}' AND regexp_full_match(value, {q('(?i)' + P.PLACEHOLDER_SHAPES[t])}))" for t in ("email", "phone", "ip", "credit_card", "ssn"))
    return f"""WITH {redacted_ctes()}, left_over AS ({values_sql('redacted', 'redacted_text', False, None, False)})
SELECT DISTINCT type, value FROM left_over WHERE NOT ({own})"""


def likely_phone(v: str, context: str) -> str:
    d = digits(v)
    return (
        f"CASE WHEN length({d}) < 7 OR starts_with({d}, '000') OR regexp_full_match({d}, '0+') THEN FALSE "
        f"WHEN {valid_phone(v, 7, None)} THEN TRUE "
        f"ELSE regexp_matches({context}, {rx(P.PHONE_CONTEXT)}) AND length({d}) BETWEEN 10 AND 13 END"
    )


IP_OK = "len(string_split(v, '.')) = 4 AND len(list_filter(string_split(v, '.'), lambda x: CAST(x AS INT) > 255)) = 0"


def inventory_sql(source: str = "chunks", location: str = "'paragraph'", only: tuple[str, ...] = ()) -> str:
    def each(category, pattern, group=0, keep="TRUE"):
        return f"""SELECT '{category}' AS category, doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, location, v AS value FROM (
  SELECT doc_id, chunk_no, {location} AS location, text, unnest(regexp_extract_all(text, {rx(pattern)}, {group})) AS v FROM {source}) t WHERE {keep}"""

    parts = {
        "EMAIL": each("EMAIL", P.EMAIL),
        "PHONE": each("PHONE", P.PHONE_LOOSE, 0, likely_phone("v", "text")),
        "IP_ADDRESS": each("IP_ADDRESS", P.IP_LOOSE, 0, IP_OK),
        "SSN": each("SSN", P.SSN),
        "CREDIT_CARD": each("CREDIT_CARD", P.CARD_LOOSE, 0, luhn("v")),
        "DATE_OF_BIRTH": each("DATE_OF_BIRTH", P.BIRTH_DATE_LOOSE, 1),
    }
    return "\nUNION ALL ".join(parts[c] for c in (only or parts))


_PLAIN = f"regexp_replace(regexp_replace(part, {q(f'(?i)</?(?:{FORMAT_TAGS})' + chr(92) + 'b[^>]*>')}, '', 'g'), '<[^>]*>', ' ', 'g')"
_NAMES = "MAP {" + ", ".join(f"{q('&' + n)}: {ord(c)}" for n, c in html5.items() if n.endswith(";") and len(n) < 9 and len(c) == 1) + "}"


def decoded(v: str) -> str:
    """Text between references as it is, references by the code points of the current standard's names."""
    code = (
        f"CASE WHEN regexp_full_match(p, '&#[0-9]+;') THEN CAST(p[3:-2] AS INT) "
        f"WHEN regexp_full_match(p, '&#[xX][0-9A-Fa-f]+;') THEN CAST('0x' || p[4:-2] AS INT) ELSE {_NAMES}[p] END"
    )
    parts = f"regexp_extract_all({v}, '&#?[A-Za-z0-9]+;|[^&]+|&')"
    return f"replace(array_to_string(list_transform({parts}, lambda p: CASE WHEN starts_with(p, '&') THEN coalesce(chr({code}), p) ELSE p END), ''), chr(160), ' ')"


_PLAIN = decoded(_PLAIN)
_SHOWN = "coalesce(html, '')"
for _h in HIDDEN:
    _SHOWN = f"regexp_replace({_SHOWN}, {q(_h)}, ' ', 'g')"


def _sum(*tags: str, minus: tuple[str, ...] = ()) -> str:
    return f"sum(CASE WHEN tag IN ({', '.join(map(q, tags))}) THEN 1 WHEN tag IN ({', '.join(map(q, minus)) or 'NULL'}) THEN -1 ELSE 0 END) OVER w"


def _last(value: str, *tags: str) -> str:
    return f"coalesce(max(CASE WHEN tag IN ({', '.join(map(q, tags))}) THEN {value} END) OVER w, 0)"


PAGES = f"""split_pages AS (SELECT page_id AS doc_id, string_split(regexp_replace({_SHOWN}, {q(f'(?i)(</?(?:{BLOCK_TAGS})' + chr(92) + 'b)')}, chr(1) || '\\1', 'g'), chr(1)) AS parts FROM pages),
page_parts AS (SELECT doc_id, i, parts[i] AS part, lower(regexp_extract(parts[i], '^<(/?[A-Za-z0-9]+)', 1)) AS tag FROM split_pages, unnest(range(1, len(parts) + 1)) t(i)),
page_counts AS (SELECT *, {_sum('nav', 'header', minus=('/nav', '/header'))} AS head, {_sum('footer', minus=('/footer',))} AS foot,
  {_last('i', 'td', 'th')} > {_last('i', '/td', '/th', 'tr', '/tr', 'table', '/table')} AS in_cell, {_sum('table')} AS tables, {_sum('tr')} AS trs, {_sum('td', 'th')} AS tds
  FROM page_parts WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
page_places AS (SELECT *, trs - {_last('trs', 'table')} AS row_at, tds - {_last('tds', 'tr', 'table')} AS col_at FROM page_counts WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
page_chunks AS MATERIALIZED (SELECT * FROM (SELECT doc_id, i AS chunk_no, {strip(_PLAIN)} AS text,
  CASE WHEN foot > 0 THEN 'footer' WHEN head > 0 THEN 'header' WHEN in_cell THEN 'cell' ELSE 'paragraph' END AS kind,
  greatest(1, tables) AS table_no, greatest(1, row_at) AS row_no, greatest(1, col_at) AS col_no FROM page_places) x WHERE text <> '')"""
PAGE_LOCATION = "CASE WHEN kind = 'cell' THEN 'table ' || table_no || ', row ' || row_no || ', column ' || col_no WHEN kind IN ('header', 'footer') THEN 'section 1 ' || kind ELSE 'paragraph' END"

_TAG, _PAIR = """<[A-Za-z][A-Za-z0-9]*((?:[^<>"']+|"[^"]*"|'[^']*')*)""", """([A-Za-z_:][A-Za-z0-9_:.-]*)\\s*=\\s*("[^"]*"|'[^']*'|[^\\s"'<>=`]+)"""
_PAIRS = f"flatten(list_transform(regexp_extract_all({_SHOWN}, {q(_TAG)}, 1), lambda t: list_zip(regexp_extract_all(t, {q(_PAIR)}, 1), regexp_extract_all(t, {q(_PAIR)}, 2))))"
_TEXT_NAMES = "['href', 'alt', 'title', 'value', 'content', 'placeholder', 'aria-label', 'summary']"
ATTRIBUTES = f"""page_pairs AS (SELECT page_id AS doc_id, list_filter({_PAIRS}, lambda p: list_contains({_TEXT_NAMES}, lower(p[1]))) AS pairs FROM pages),
attribute_values AS (SELECT doc_id, i AS chunk_no, lower(pairs[i][1]) AS attribute, {strip(decoded("regexp_replace(pairs[i][2], '^[\"'']|[\"'']$', '', 'g')"))} AS v FROM page_pairs, unnest(range(1, len(pairs) + 1)) t(i)),
page_attributes AS MATERIALIZED (SELECT * FROM (SELECT doc_id, chunk_no, attribute, CASE WHEN regexp_matches(v, '(?i)^(mailto|tel):') THEN regexp_extract(v, '^[A-Za-z]+:([^?]*)', 1) ELSE v END AS text FROM attribute_values) a
  WHERE regexp_matches(text, '\\S'))"""

FIELD_LOCATION = "'table ' || table_no || ', row ' || row_no || ', column ' || col_no"
TEXTS = f"texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT {TURN_ID_BASE} + conv_id * 1000 + turn, text FROM conversations)"
MIXED_CHUNKS = f"""{TEXTS}, {line_chunks('texts', 'text_lines')}, {FIELDS}, chunks AS MATERIALIZED (
  SELECT doc_id, chunk_no, 'paragraph' AS kind, 0 AS table_no, 'paragraph' AS location, text FROM text_lines
  UNION ALL SELECT doc_id, chunk_no, 'cell', table_no, {FIELD_LOCATION}, text FROM fields)"""
FIELD_CHUNKS = f"{FIELDS}, chunks AS (SELECT * FROM fields)"


def sweep_ctes() -> str:
    names = [*NAMES["explicit"], *NAMES["known"]]
    values = ", ".join(f"({i}, {q(n)})" for i, n in enumerate(names))
    text = "redacted_text"
    for i, n in enumerate(names):
        quoted = n.replace(".", r"\.")
        text = f"regexp_replace({text}, {q('(?i)' + quoted)}, (SELECT coalesce(max(replacement), {q(n)}) FROM entries WHERE name_no = {i}), 'g')"
    return f"""{redacted_ctes(DETECTORS)}, names AS (SELECT * FROM (VALUES {values}) t(name_no, name)),
hits AS MATERIALIZED (SELECT doc_id, chunk_no, name_no, name FROM redacted JOIN names ON contains(lower(redacted_text), lower(name))),
known AS (SELECT name_no, replacement FROM names JOIN dictionary ON type = 'person' AND norm_key = lower(name)),
fresh AS (SELECT name_no, row_number() OVER (ORDER BY first) + (SELECT coalesce(max(n), 0) FROM dictionary WHERE type = 'person') AS n
          FROM (SELECT name_no, min({{'d': doc_id, 'c': chunk_no, 'n': name_no}}) AS first FROM hits
                WHERE name_no NOT IN (SELECT name_no FROM known) GROUP BY name_no) x),
entries AS (SELECT name_no, replacement FROM known UNION ALL SELECT name_no, 'Person ' || n FROM fresh),
swept AS (SELECT doc_id, chunk_no, {text} AS swept_text FROM redacted)"""


def document_sweep_ctes() -> str:
    """As above, but names are known and numbered within each document."""
    names = [*NAMES["explicit"], *NAMES["known"]]
    values = ", ".join(f"({i}, {q(n)})" for i, n in enumerate(names))
    text = "redacted_text"
    for i, n in enumerate(names):
        quoted = n.replace(".", r"\.")
        text = f"regexp_replace({text}, {q('(?i)' + quoted)}, coalesce(r{i}, {q(n)}), 'g')"
    each = ", ".join(f"max(replacement) FILTER (WHERE name_no = {i}) AS r{i}" for i in range(len(names)))
    return f"""{redacted_ctes(DETECTORS, scope='document')}, names AS (SELECT * FROM (VALUES {values}) t(name_no, name)),
hits AS MATERIALIZED (SELECT doc_id, chunk_no, name_no, name FROM redacted JOIN names ON contains(lower(redacted_text), lower(name))),
known AS (SELECT doc_id, name_no, replacement FROM names JOIN dictionary ON type = 'person' AND norm_key = lower(name)),
tops AS (SELECT doc_id, max(n) AS top FROM dictionary WHERE type = 'person' GROUP BY doc_id),
fresh AS (SELECT doc_id, name_no, row_number() OVER (PARTITION BY doc_id ORDER BY first) + coalesce(top, 0) AS n
          FROM (SELECT doc_id, name_no, min({{'c': chunk_no, 'n': name_no}}) AS first FROM hits ANTI JOIN known USING (doc_id, name_no) GROUP BY doc_id, name_no) x
          LEFT JOIN tops USING (doc_id)),
entries AS MATERIALIZED (SELECT doc_id, name_no, replacement FROM known UNION ALL SELECT doc_id, name_no, 'Person ' || n FROM fresh),
swept AS (SELECT doc_id, chunk_no, {text} AS swept_text FROM redacted LEFT JOIN (SELECT doc_id, {each} FROM entries GROUP BY doc_id) e USING (doc_id))"""


def large_gazetteer_query() -> str:
    """Occurrences by splitting at each name, then their neighbours."""
    letter = "regexp_matches(substring(text, {}, 1), '[A-Za-z]')"
    return f"""WITH {BASE}, {CELLS}, names AS ({name_list_sql()}),
parts AS (SELECT doc_id, chunk_no, text, list, name, string_split(lower(text), lower(name)) AS p FROM chunks JOIN names ON contains(lower(text), lower(name))),
found AS (SELECT *, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(name) AS BIGINT) AS st FROM parts, unnest(range(1, len(p))) t(i))
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, st AS start, st + length(name) AS "end", 'person' AS type, substring(text, st + 1, length(name)) AS value,
CAST(CASE list WHEN 'explicit' THEN 2 ELSE 11 END AS BIGINT) AS detector_rank
FROM found WHERE NOT (st > 0 AND {letter.format('st')}) AND NOT {letter.format('st + length(name) + 1')}"""


def name_occurrences_query() -> str:
    found = large_gazetteer_query()
    return f"SELECT doc_id, chunk_no, start, \"end\", list, name, value FROM ({found.replace('SELECT doc_id, CAST(chunk_no AS BIGINT)', 'SELECT list, name, doc_id, CAST(chunk_no AS BIGINT)')}) z"


def gazetteer_query() -> str:
    return f"""WITH {BASE}, {CELLS}, {spans_cte(NAME_LISTS).replace('AND NOT ' + is_placeholder('value'), '')}
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(st AS BIGINT) AS start, CAST(en AS BIGINT) AS "end", type, value, CAST(rk AS BIGINT) AS detector_rank FROM spans"""


def all_rows(ctes: str, source: str) -> str:
    return f"""WITH {ctes}
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(st AS BIGINT) AS start, CAST(en AS BIGINT) AS "end", type, value, CAST(rk AS BIGINT) AS detector_rank FROM {source}"""


def _entities_query() -> str:
    extra = (
        f"UNION ALL SELECT doc_id, chunk_no, context AS text, start AS st, \"end\" AS en, value, 13 AS rk, 'person' AS type FROM ({people()}) p"
        f" UNION ALL SELECT doc_id, chunk_no, context AS text, start AS st, \"end\" AS en, value, 13 AS rk, 'organization' AS type FROM ({ORGS}) o"
    )
    listed = "\nUNION ALL ".join(f"SELECT doc_id, chunk_no, text, st, en, value, rk, type FROM ({detector_sql(n)}) z" for n in NAME_LISTS)
    return f"""WITH {BASE}, {line_chunks()}, {CANDIDATES}, {spans_cte(DETECTORS, extra=f'UNION ALL {listed} {extra}')},
{LONGEST}, {dictionary_cte()}, {splice_cte()}
SELECT {CHUNK_COLUMNS} FROM redacted"""


def _plan_values() -> str:
    return ", ".join(f"('{cc}', '{label}', {lo}, {hi}, '{lead}')" for cc, label, lo, hi, lead in NUMBERING_PLAN)


def build() -> dict[str, str]:
    alls = DETECTORS + NAME_LISTS
    sql: dict[str, str] = {
        "chunk_scan": f"WITH {BASE}, {line_chunks()} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, text FROM chunks",
        "cell_scan": f"WITH {FIELDS} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(table_no AS BIGINT) AS table_no, CAST(row_no AS BIGINT) AS row_no, CAST(col_no AS BIGINT) AS col_no, {FIELD_LOCATION} AS location, text FROM fields",
        "page_scan": f"WITH {PAGES} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, {PAGE_LOCATION} AS location, text FROM page_chunks",
        "page_attributes": f"WITH {ATTRIBUTES} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, attribute, text FROM page_attributes",
        "substring_survivors": f"""WITH {redacted_ctes(chunks=line_chunks())}, vals AS MATERIALIZED (SELECT DISTINCT type, value, {digits('value')} AS d FROM ({values_sql('chunks', 'text', False)}) v),
after AS MATERIALIZED (SELECT lower(redacted_text) AS low, regexp_extract_all(redacted_text, '\\d{{10,13}}') AS runs FROM redacted WHERE regexp_matches(redacted_text, '[0-9@]'))
SELECT type, value, count(*) AS chunks FROM vals JOIN after ON contains(low, lower(value)) OR (type = 'phone' AND list_contains(runs, d)) GROUP BY type, value""",
        "text_assembly_corpus": f"WITH {BASE}, {line_chunks()} SELECT doc_id, string_agg(text, chr(10) ORDER BY chunk_no) AS text FROM chunks GROUP BY doc_id",
        "spans_card_any": spans_query("credit_card", False),
        "spans_gazetteer": gazetteer_query(),
        "all_spans": all_rows(f"{BASE}, {CELLS}, {spans_cte(alls)}", "spans"),
        "resolve_overlaps": all_rows(f"{BASE}, {CELLS}, {spans_cte(alls)}, {LONGEST}", "merged"),
        "resolve_cover": all_rows(f"{BASE}, {CELLS}, {spans_cte(alls)}, {COVER}", "merged"),
        "dictionary": f"WITH {BASE}, {CELLS}, {spans_cte(alls)}, {LONGEST}, {dictionary_cte()} SELECT type, norm_key, CAST(n AS BIGINT) AS n, uses, replacement FROM dictionary",
        "dictionary_per_document": f"WITH {BASE}, {CELLS}, {spans_cte(alls)}, {LONGEST}, {dictionary_cte('document')} SELECT doc_id, type, norm_key, CAST(n AS BIGINT) AS n, uses, replacement FROM dictionary",
        "redacted_chunks": f"WITH {redacted_ctes()} SELECT {CHUNK_COLUMNS} FROM redacted",
        "redacted_chunks_strict": f"WITH {BASE}, {line_chunks()}, {spans_cte(alls, True)}, {COVER}, {dictionary_cte(overflow=True)}, {splice_cte()} SELECT {CHUNK_COLUMNS} FROM redacted",
        "redacted_pages": f"""WITH {PAGES}, chunks AS MATERIALIZED (SELECT * FROM page_chunks WHERE kind IN ('paragraph', 'cell')),
{spans_cte(alls)}, {LONGEST}, {dictionary_cte()}, {splice_cte()} SELECT {CHUNK_COLUMNS} FROM redacted""",
        "redacted_documents": f"""WITH {redacted_ctes(chunks=line_chunks(), scope='document')},
every_line AS (SELECT doc_id, i AS chunk_no, parts[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM corpus), unnest(range(1, len(parts) + 1)) t(i))
SELECT e.doc_id, string_agg(coalesce(r.redacted_text, e.text), chr(10) ORDER BY e.chunk_no) AS redacted_text, CAST(coalesce(sum(r.n_redactions), 0) AS BIGINT) AS n_redactions
FROM every_line e LEFT JOIN redacted r ON e.doc_id = r.doc_id AND e.chunk_no = r.chunk_no GROUP BY e.doc_id""",
        "redacted_hashed": hashed_query(BASE),
        "redacted_hashed_twice": hashed_twice_query(),
        "redacted_deliveries": f"WITH {redacted_ctes()} SELECT {CHUNK_COLUMNS} FROM redacted",
        "dictionary_deliveries": f"""WITH {BASE}, {CELLS}, {spans_cte(alls)}, {LONGEST}, {dictionary_cte()}
SELECT d.type, d.norm_key, CAST(d.n AS BIGINT) AS n, d.replacement, CAST(CASE WHEN min(k.doc_id) >= {TURN_ID_BASE} THEN 2 ELSE 1 END AS BIGINT) AS delivery
FROM dictionary d JOIN keyed k USING (type, norm_key) GROUP BY d.type, d.norm_key, d.n, d.replacement""",
        "redactions_per_document": f"""WITH {redacted_ctes(chunks=line_chunks(), scope='document')},
places AS (SELECT doc_id, i AS chunk_no, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x) + 1)), 0) AS off FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM corpus), unnest(range(1, len(parts) + 1)) t(i))
SELECT r.doc_id, CAST(st + off AS BIGINT) AS start, CAST(en + off AS BIGINT) AS "end", r.type, r.value, CAST(d.n AS BIGINT) AS n, r.replacement
FROM replaced r JOIN places p ON r.doc_id = p.doc_id AND r.chunk_no = p.chunk_no
JOIN dictionary d ON d.doc_id = r.doc_id AND d.type = r.type AND d.norm_key = lower({strip('r.value')})""",
        "stream_redacted_corpus": hashed_query(BASE),
        "redacted_entities": _entities_query(),
        "redacted_entities_in_rows": _entities_query(),
        "entities_by_function": f'''{WITH_CANDIDATES} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", label, text FROM candidates''',
        "findings_corpus": f"""WITH {MIXED_CHUNKS}, {spans_cte(alls)}, {LONGEST}, {dictionary_cte()}, {splice_cte()}
SELECT r.doc_id, location, CAST(st AS BIGINT) AS st, CAST(en AS BIGINT) AS en, type, value, replacement
FROM replaced r JOIN chunks c ON r.doc_id = c.doc_id AND r.chunk_no = c.chunk_no""",
        "redaction_counts": f"WITH {BASE}, {CELLS}, {spans_cte(alls)}, {LONGEST} SELECT coalesce(type, 'total') AS type, count(*) AS n FROM merged GROUP BY ROLLUP (type)",
        "name_sweep": f"WITH {sweep_ctes()} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, swept_text FROM swept",
        "name_sweep_findings": f"WITH {sweep_ctes()} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, name AS original, replacement FROM hits JOIN entries USING (name_no)",
        "name_sweep_per_document": f"WITH {document_sweep_ctes()} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, swept_text FROM swept",
        "name_sweep_findings_per_document": f"WITH {document_sweep_ctes()} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, name AS original, replacement FROM hits JOIN entries USING (doc_id, name_no)",
        "spans_gazetteer_large": large_gazetteer_query(),
        "name_occurrences": name_occurrences_query(),
        "survival_report": survival_query(False, False),
        "survival_report_exact": survival_query(True, True),
        "survivors": f"WITH {redacted_ctes()}, {survivors_cte(False, False)} SELECT doc_id, type, value FROM survivors WHERE survived",
        "corpus_survivors": f"""WITH {redacted_ctes()}, a AS ({values_sql('redacted', 'text', True)}), b AS ({values_sql('redacted', 'redacted_text', True)})
SELECT DISTINCT type, key FROM (SELECT type, CASE WHEN type = 'phone' THEN {digits('value')} ELSE lower(value) END AS key FROM a) x
WHERE (type, key) IN (SELECT (type, CASE WHEN type = 'phone' THEN {digits('value')} ELSE lower(value) END) FROM b)""",
        "sensitive_values": f"WITH {BASE}, v AS ({values_sql('corpus', 'text', True)}) SELECT type, count(DISTINCT value) AS n FROM v GROUP BY type",
        "placeholder_counts": f"WITH {redacted_ctes()} "
        + " UNION ALL ".join(
            f"SELECT '{t}' AS type, CAST(coalesce(sum(len(regexp_extract_all(redacted_text, {q('(?i)' + s)}))), 0) AS BIGINT) AS n FROM redacted"
            for t, s in P.PLACEHOLDER_SHAPES.items()
        ),
        "character_counts": f"WITH {redacted_ctes()} SELECT CAST(sum(length(text)) AS BIGINT) AS original_characters, CAST(sum(length(redacted_text)) AS BIGINT) AS redacted_characters FROM redacted",
        "residual_values": residuals_query(),
        "residual_entities": f"""{with_residuals()} SELECT DISTINCT label, {strip('text')} AS value FROM candidates
WHERE NOT (label = 'PERSON' AND regexp_full_match({strip('text')}, '(?i)Person \\d+')) AND NOT (label = 'ORG' AND regexp_full_match({strip('text')}, '(?i)Example Organization \\d+'))""",
        "pii_inventory": f"WITH {BASE}, {line_chunks()} {inventory_sql()}",
        "page_inventory": f"WITH {PAGES} {inventory_sql('page_chunks', PAGE_LOCATION)}",
        "inventory_cards": f"WITH {BASE}, {line_chunks()} {inventory_sql(only=('CREDIT_CARD',))}",
        "inventory_phones": f"WITH {BASE}, {line_chunks()} {inventory_sql(only=('PHONE',))}",
        "inventory_sink": f"""WITH {BASE}, {line_chunks()}, f AS ({inventory_sql()}) SELECT 'findings' AS part, category, doc_id, chunk_no, location, value, NULL AS n FROM f
UNION ALL SELECT 'counts', category, NULL, NULL, NULL, NULL, count(*) FROM f GROUP BY category""",
        "inventory_counts": f"WITH {BASE}, {line_chunks()}, f AS ({inventory_sql()}) SELECT category, count(*) AS n FROM f GROUP BY category ORDER BY category",
        "address_inventory": f"""WITH {BASE}, {line_chunks()}
SELECT 'EXPLICIT_ADDRESS_CONTEXT' AS category, doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, 'paragraph' AS location, text AS value FROM chunks WHERE regexp_matches(text, {rx(P.ADDRESS_CONTEXT)})
UNION ALL SELECT 'PIN_CODE', doc_id, CAST(chunk_no AS BIGINT), 'paragraph', unnest(regexp_extract_all(text, {rx(P.PIN)})) FROM chunks""",
        "scan_totals": f"WITH {BASE}, {line_chunks()}, f AS ({inventory_sql()}) SELECT (SELECT count(*) FROM chunks) AS chunks_scanned, (SELECT count(*) FROM f) AS candidates_found",
        "phone_countries": f"""WITH {BASE}, {CELLS}, {spans_cte(['phone'])}, e AS (SELECT {e164('value')} AS e164 FROM spans), plan AS (SELECT * FROM (VALUES {_plan_values()}) t(country_code, label, lo, hi, lead))
SELECT country_code, label, count(*) AS n FROM e JOIN plan ON starts_with(e164, country_code) AND length(e164) - length(country_code) BETWEEN lo AND hi
 AND regexp_matches(substring(e164, length(country_code) + 1), '^(?:' || lead || ')') GROUP BY country_code, label""",
        "name_likeness": f"""{WITH_CANDIDATES} SELECT value, cleaned, {person('cleaned')} AS is_name FROM (
SELECT value, {clean('value')} AS cleaned FROM (SELECT DISTINCT text AS value FROM candidates) a) b""",
        "ner_filter_person": f"""{WITH_CANDIDATES} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", 'person' AS type, value FROM ({people(NAMES['known'])}) p""",
        "ner_filter_org": f"""{WITH_CANDIDATES} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", 'organization' AS type, value FROM ({ORGS}) p""",
        "ner_inventory": f"{WITH_CANDIDATES} SELECT label AS category, doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, text AS value FROM candidates",
        "segments": rf"""WITH {BASE}, {CELLS} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(o AS BIGINT) AS "offset", substring(text, o + 1, 2000) AS segment
FROM chunks, unnest(range(0, length(text), 2000)) t(o) WHERE regexp_matches(substring(text, o + 1, 2000), '\S')""",
        "numbered_candidates": f"""{with_residuals()}, r AS (SELECT DISTINCT label, {strip('text')} AS value FROM candidates
WHERE NOT (label = 'PERSON' AND regexp_full_match({strip('text')}, '(?i)Person \\d+')) AND NOT (label = 'ORG' AND regexp_full_match({strip('text')}, '(?i)Example Organization \\d+'))),
k AS (SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY lower(value), value) AS n FROM r)
SELECT label, CAST(n AS BIGINT) AS n, lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0') || '. ' || value AS line FROM k""",
        "important_names": _name_check_query(),
        "keyword_in_context": f"""WITH {BASE}, {CELLS} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(st AS BIGINT) AS "position", value AS found,
replace(substring(text, greatest(st - 180, 0) + 1, en + 180 - greatest(st - 180, 0)), chr(10), ' ') AS context FROM ({raw_spans('(?i)nilam varden')}) r""",
        "structure_counts_corpus": f"""WITH {PAGES}, {MIXED_CHUNKS}, u AS (
SELECT 'page' AS source, doc_id, kind, CASE WHEN kind = 'cell' THEN table_no ELSE 0 END AS table_no, text FROM page_chunks UNION ALL SELECT 'corpus', doc_id, kind, table_no, text FROM chunks)
SELECT source, doc_id, count(*) FILTER (WHERE kind = 'paragraph') AS paragraphs, count(*) FILTER (WHERE kind = 'cell') AS cells, CAST(max(table_no) AS BIGINT) AS tables,
count(*) FILTER (WHERE kind = 'header') AS headers, count(*) FILTER (WHERE kind = 'footer') AS footers, CAST(sum(length(text)) AS BIGINT) AS characters, 1 AS sections FROM u GROUP BY source, doc_id""",
        "first_paragraphs": f"""WITH {BASE}, {line_chunks()} SELECT doc_id, CAST(r AS BIGINT) AS rank, substring({strip('text')}, 1, 300) AS head
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) AS r FROM chunks) x WHERE r <= 20""",
        "table_sizes": f"WITH {FIELDS} SELECT doc_id, CAST(table_no AS BIGINT) AS table_no, CAST(max(row_no) AS BIGINT) AS n_rows, CAST(max(col_no) AS BIGINT) AS n_cols FROM fields WHERE table_no <= 10 GROUP BY doc_id, table_no",
    }
    for name in ("text_assembly", "stream_redacted", "findings", "structure_counts"):
        sql[name] = sql[f"{name}_corpus"]
    sql["redacted_sink"] = f"""SELECT CASE WHEN doc_id >= {TURN_ID_BASE} THEN 'turns' WHEN doc_id >= {CARD_ID_BASE} THEN 'cards' ELSE 'documents' END AS source, * FROM ({sql['redacted_documents']}) r"""
    for key, detector in {
        "spans_email": "email", "spans_ip": "ip", "spans_ssn": "ssn", "spans_card_luhn": "credit_card", "spans_phone": "phone",
        "spans_dob": "dob", "spans_labelled_name": "labelled_name", "spans_labelled_org": "labelled_organization",
        "spans_labelled_address": "labelled_address", "spans_address_window": "address_window",
    }.items():
        sql[key] = spans_query(detector)
    return sql


def _name_check_query() -> str:
    values = ", ".join(f"('{tag}', {q(n)})" for tag, names in NAMES.items() for n in names)
    hit = "regexp_matches(redacted_text, '(?i)(^|[^A-Za-z])' || replace(name, '.', '\\.') || '($|[^A-Za-z])')"
    return f"""WITH {redacted_ctes(DETECTORS + ('explicit_names',))}, names AS (SELECT * FROM (VALUES {values}) t(list, name))
SELECT list, name, CASE WHEN count(r.doc_id) = 0 THEN 'REDACTED' ELSE 'STILL PRESENT' END AS status, count(r.doc_id) AS chunks
FROM names LEFT JOIN redacted r ON {hit} GROUP BY list, name"""
