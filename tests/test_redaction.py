"""Whole flows on small fixtures: numbering, idempotence, sweeps, streams."""

import random
import re
import zipfile
from collections import defaultdict
from dataclasses import replace
from html.parser import HTMLParser

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quietmark.functions.vocab import SAMPLE_NAMES
from quietmark.operators import audit, entities, gazetteer, review
from quietmark.operators import dictionary as D
from quietmark.operators.detectors import PARITY, STRICT, detect, span_rows
from quietmark.operators.overlaps import with_merged
from quietmark.plans.redaction import redact, redact_documents, redact_hashed
from quietmark.sources.cards import contact_cards
from quietmark.sources.chunks import assemble, chunk_text, location, page_chunks, redaction_scope
from quietmark.sources.tables import table
from quietmark.sources.sinks import write_inventory, write_redacted
from quietmark.sources.word import word_chunks
from quietmark.streaming.redact import read_texts, redact_stream, write_stream

SF = "/root/testdata/sf0.001"
LISTED = replace(STRICT, explicit_names=SAMPLE_NAMES["explicit"], known_names=SAMPLE_NAMES["known"])


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")


def test_numbering_equals_a_plain_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaab"), i) for i in rng.sample(range(100_000), 5_000)] + [("c", 1)]
    df = spark.createDataFrame(rows, "g string, o int")
    plain = df.withColumn("m", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    both = D.number_in_order(df, ["g"], "o").join(plain, ["g", "o"])
    assert both.count() == len(rows)
    assert both.where("n <> m").count() == 0


def test_numbering_many_small_groups(spark):
    df = spark.range(4_000).select((F.col("id") % 900).alias("g"), F.col("id").alias("o"))
    plain = df.withColumn("m", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    assert D.number_in_order(df, ["g"], "o").join(plain, ["g", "o"]).where("n = m").count() == 4_000


def test_first_appearance_order_and_reuse(spark):
    text = docs(spark, "b@x.io A@x.io\na@X.io", "c@x.io b@x.io")
    done = redact(chunk_text(text), PARITY)
    out = {(r["doc_id"], r["chunk_no"]): r["redacted_text"] for r in done.chunks.collect()}
    assert out == {
        (1, 1): "person1@example.com person2@example.com",
        (1, 2): "person2@example.com",
        (2, 1): "person3@example.com person1@example.com",
    }
    own = redact(chunk_text(text), PARITY, "document").chunks.where("doc_id = 2").first()
    assert own["redacted_text"] == "person1@example.com person2@example.com"


def test_hot_values_and_cold_values_both_get_replaced(spark, monkeypatch):
    monkeypatch.setattr(D, "HOT_KEYS", 2)
    texts = [f"help@x.io u{i}@x.io" for i in range(50)]
    done = redact(chunk_text(docs(spark, *texts)), PARITY)
    assert done.findings.count() == 100
    assert done.findings.where("replacement is null").count() == 0
    assert done.findings.where("norm_key = 'help@x.io'").select("replacement").distinct().count() == 1


def test_redaction_is_idempotent(spark):
    cards = contact_cards(spark, SF)
    once = redact_documents(cards, LISTED).select("doc_id", F.col("redacted_text").alias("text"))
    again = redact_documents(once, LISTED)
    assert once.count() == cards.count()
    assert again.where("n_redactions > 0").count() == 0
    assert again.where("text <> redacted_text").count() == 0


def test_cover_leaves_no_detected_text(spark):
    found = with_merged(detect(chunk_text(contact_cards(spark, SF), mode="cell"), LISTED).withColumn("all", F.col("spans")), "cover")
    inside = lambda s: F.exists("merged", lambda m: (m["st"] <= s["st"]) & (s["en"] <= m["en"]))
    assert found.where(~F.forall("all", inside)).count() == 0
    assert found.where(F.size("merged") > 0).count() > 100


def test_text_outside_spans_is_kept(spark):
    cards = contact_cards(spark, SF)
    done = redact(chunk_text(cards, mode="cell"), LISTED)
    spans = defaultdict(list)
    for r in done.findings.collect():
        spans[r["doc_id"]].append((r["st"], r["en"], r["replacement"]))
    for r in done.chunks.collect():
        out, at = [], 0
        for st, en, new in sorted(spans[r["doc_id"]]):
            out += [r["text"][at:st], new]
            at = en
        assert r["redacted_text"] == "".join(out) + r["text"][at:]
        assert r["n_redactions"] == len(spans[r["doc_id"]])


def test_dictionary_is_injective(spark):
    done = redact(chunk_text(contact_cards(spark, SF)), LISTED)
    named = done.dictionary.where("type <> 'dob'")
    assert named.select("replacement").distinct().count() == named.count()
    gaps = done.dictionary.groupBy("type").agg(F.max("n").alias("top"), F.count("*").alias("size"))
    assert gaps.where("top <> size").count() == 0


def test_documents_keep_blank_lines(spark):
    text = docs(spark, "\n\n a@x.io é\n\nb@x.io a@x.io\n", "quiet\n", "")
    out = {r["doc_id"]: (r["redacted_text"], r["n_redactions"]) for r in redact_documents(text).collect()}
    assert out == {
        1: ("\n\n person1@example.com é\n\nperson2@example.com person1@example.com\n", 3),
        2: ("quiet\n", 0),
        3: ("", 0),
    }


def test_canonical_keys_share_a_placeholder(spark):
    text = docs(spark, "+91 98765 43210 and +91-9876543210")
    for canonical, n in ((False, 2), (True, 1)):
        done = redact(chunk_text(text), replace(PARITY, canonical_keys=canonical))
        assert done.dictionary.count() == n


def test_hashed_tokens_are_stable(spark):
    text = docs(spark, "a@x.io", "see A@X.io")
    one, two = [r["redacted_text"] for r in redact_hashed(chunk_text(text), secret="k").orderBy("doc_id").collect()]
    assert two == f"see {one}" and one.startswith("[EMAIL-")


def test_hashed_tokens_are_left_alone(spark):
    """Ten thousand values of every kind, redacted again and again."""
    rows = spark.range(10_000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("mail u"), "id", F.lit("@x.io, call +91 98765 "), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit(", ssn 123-45-"), F.lpad((F.col("id") % 10_000).cast("string"), 4, "0")).alias("text"),
    )
    once = redact_hashed(chunk_text(rows), secret="k").select("doc_id", F.col("redacted_text").alias("text"), "n_redactions")
    again = redact_hashed(chunk_text(once), secret="k")
    assert once.agg(F.min("n_redactions")).first()[0] == 3
    assert again.where("n_redactions > 0").count() == 0


def test_a_secret_is_required(spark):
    with pytest.raises(ValueError, match="secret"):
        redact_hashed(chunk_text(docs(spark, "a@x.io")), secret="")


def test_another_text_column_leaves_text_alone(spark):
    df = spark.createDataFrame([(1, "keep me", "mail a@x.io"), (2, "keep", "quiet")], "doc_id bigint, text string, body string")
    rows = redact_documents(df, text_col="body").orderBy("doc_id").collect()
    assert [(r["text"], r["body"], r["redacted_text"]) for r in rows] == [("keep me", "mail a@x.io", "mail person1@example.com"), ("keep", "quiet", "quiet")]


def test_stream_equals_batch(spark, tmp_path):
    texts = docs(spark, *[f"line {i}\nmail u{i % 3}@x.io\nquiet" for i in range(20)])
    texts.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = redact_stream(read_texts(spark, str(tmp_path / "in")), STRICT, secret="k")
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "offsets")).awaitTermination()
    key = ["doc_id", "chunk_no", "redacted_text", "n_redactions"]
    batch = redact_hashed(chunk_text(texts), STRICT, secret="k").select(*key)
    got = spark.read.parquet(str(tmp_path / "out")).select(*key)
    assert got.count() == 60 and got.exceptAll(batch).count() == 0


def brute_names(texts, names):
    import re

    out = set()
    for i, t in texts:
        for tag, n in names:
            for m in re.finditer(rf"(?<![A-Za-z]){re.escape(n)}(?![A-Za-z])", t, re.IGNORECASE):
                out.add((i, m.start(), m.end()))
    return out


def test_gazetteer_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    names = [("known", "Anna Lee"), ("known", "Anna B. Lee"), ("known", "Lee Anna"), ("explicit", "Bo"), ("explicit", "anna lee anna")]
    bits = ["Anna", "anna", "ANNA", "Lee", "lee", "B.", "Bo", "boa", "x", "é", "1"]
    seps = [" ", "  ", "\n", ". ", "", "-"]
    texts = [(i, "".join(rng.choice(bits) + rng.choice(seps) for _ in range(rng.randint(1, 12)))) for i in range(1500)]
    df = chunk_text(spark.createDataFrame(texts, "doc_id bigint, text string"), mode="cell")
    listed = spark.createDataFrame(names, "list string, name string")
    want = brute_names(texts, names)
    for limit in (gazetteer.BROADCAST_BYTES, 0):  # broadcast, then shuffled list
        monkeypatch.setattr(gazetteer, "BROADCAST_BYTES", limit)
        rows = gazetteer.gazetteer_spans(df, listed).collect()
        assert {(r["doc_id"], r["start"], r["end"]) for r in rows} == want
        assert len(rows) == len(want)


def test_literal_names_equal_the_table_join(spark):
    cards = chunk_text(contact_cards(spark, SF), mode="cell")
    rules = replace(PARITY, explicit_names=SAMPLE_NAMES["explicit"], known_names=SAMPLE_NAMES["known"], only=("explicit_names", "known_names"))
    a = span_rows(detect(cards, rules))
    b = gazetteer.gazetteer_spans(cards, gazetteer.gazetteer(spark, SAMPLE_NAMES))
    assert a.count() == b.count() > 0
    assert a.select(*b.columns).exceptAll(b).count() == 0


def test_sweep_bounds_and_numbers(spark):
    done = redact(chunk_text(docs(spark, "Name: Asha Varma", "xNilam Varden, asha varma", "Nilam Varden")), replace(STRICT, only=("labelled_name",)))
    names = ["Nilam Varden", "Asha Varma", "Never There"]
    swept, found = gazetteer.sweep_names(done, names)
    assert [r["swept_text"] for r in swept.orderBy("doc_id").collect()] == ["Name: Person 1", "xNilam Varden, Person 1", "Person 2"]
    assert found.count() == 2
    loose, _ = gazetteer.sweep_names(done, names, bounded=False)
    assert [r["swept_text"] for r in loose.orderBy("doc_id").collect()] == ["Name: Person 1", "xPerson 2, Person 1", "Person 2"]


def test_segments_and_shift(spark):
    text = "a" * 4500
    df = chunk_text(docs(spark, text, "short"), mode="cell")
    assert [(r["offset"], len(r["segment"])) for r in entities.segments(df).orderBy("doc_id", "offset").collect()] == [(0, 2000), (2000, 2000), (4000, 500), (0, 5)]
    lapped = entities.segments(df, 2000, 100).where("doc_id = 1").orderBy("offset").collect()
    assert [r["offset"] for r in lapped] == [0, 1900, 3800]
    assert lapped[-1]["offset"] + len(lapped[-1]["segment"]) == 4500
    found = spark.createDataFrame([(1, 1, 0, 1950, 1960, "ORG", "x"), (1, 1, 1900, 50, 60, "ORG", "x")], "doc_id long, chunk_no long, offset long, start long, end long, label string, text string")
    assert [(r["start"], r["end"]) for r in entities.shift_back(found).collect()] == [(1950, 1960)]


def test_entity_filters(spark):
    text = "Flat near Lake Road, Hill Building floor Rahul Varma Pune. " + "x" * 100 + " Asha Lind Director said"
    rows = [(1, 1, text.index(n), text.index(n) + len(n), "PERSON", n) for n in ("Rahul Varma", "Asha Lind Director")]
    cand = spark.createDataFrame(rows, "doc_id long, chunk_no long, start long, end long, label string, text string")
    chunks = chunk_text(docs(spark, text), mode="cell")
    start = text.index("Asha Lind")
    wide = entities.filter_people(cand, chunks, PARITY).collect()
    assert [(r["start"], r["end"], r["value"]) for r in wide] == [(start, start + 18, "Asha Lind")]
    narrow = entities.filter_people(cand, chunks, STRICT).collect()
    assert [(r["start"], r["end"], r["value"]) for r in narrow] == [(start, start + 9, "Asha Lind")]


def test_survival(spark):
    pairs = spark.createDataFrame(
        [(1, "ip 1.2.3.4 tel +91 98765 43210", "ip 11.2.3.45 tel 919876543210"), (2, "a@x.io", "gone"), (3, "none", "none")],
        "doc_id bigint, text string, redacted_text string",
    )
    loose = {r["type"]: (r["original"], r["survived"], r["status"]) for r in audit.survival_report(audit.survivor_rows(pairs, PARITY)).collect()}
    assert loose["ip"] == (1, 1, "FAIL") and loose["phone"] == (1, 1, "FAIL") and loose["email"] == (1, 0, "PASS")
    assert loose["ssn"] == (0, 0, "PASS") and loose["total"] == (3, 2, "FAIL")
    exact = {r["type"]: r["survived"] for r in audit.survival_report(audit.survivor_rows(pairs, PARITY, True)).collect()}
    assert exact["ip"] == 0 and exact["phone"] == 1


def test_survival_of_a_full_run(spark):
    done = redact(chunk_text(contact_cards(spark, SF), mode="cell"), LISTED)
    left = audit.survivor_rows(done.chunks, LISTED).where("survived")
    # only what was a placeholder before the run is still there
    assert left.where("not (type = 'email' and value rlike '^person[0-9]+@example[.]com$')").count() == 0


def test_residuals_and_counts(spark):
    after = spark.createDataFrame([(1, "Person 3 person1@example.com X@y.io 4111-1111-1111-0009 1234 5678 1234 5678 person 4")], "doc_id bigint, redacted_text string")
    assert {tuple(r) for r in audit.residual_values(after).collect()} == {("email", "X@y.io"), ("credit_card", "1234 5678 1234 5678")}
    counts = {r["type"]: r["n"] for r in audit.placeholder_counts(after).collect()}
    assert counts["person"] == 2 and counts["email"] == 1 and counts["credit_card"] == 1 and counts["address"] == 0


def test_sweep_under_document_numbering(spark):
    """Every document has its own numbers; a name known in one is new in the other."""
    text = docs(spark, "Name: Asha Varma\nsee Asha Varma and Tomas Lind", "quiet", "Tomas Lind met Asha Varma", "Name: Tomas Lind\nTomas Lind")
    done = redact(chunk_text(text), STRICT, numbering="document")
    swept, found = gazetteer.sweep_names(done, ["Tomas Lind", "Asha Varma"])
    got = defaultdict(list)
    for r in swept.orderBy("doc_id", "chunk_no").collect():
        got[r["doc_id"]].append(r["swept_text"])
    assert got[1][1] == "see Person 1 and Person 2" and got[2] == ["quiet"]
    assert got[3] == ["Person 1 met Person 2"] and got[4][1] == "Person 1"
    keys = [(r["doc_id"], r["chunk_no"], r["original"]) for r in found.collect()]
    assert len(keys) == len(set(keys)) == 5


def test_long_name_lists_and_other_letters(spark):
    names = [f"Nora Q{'abcdefghij'[i // 100]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}" for i in range(1000)]
    names += ["André", "José Álvarez", "Élan", "中村", r"Odd \E Name"]
    text = docs(spark, "NORA QJJJ and ANDRÉ", "josé álvarez, JOSÉ ÁLVAREZ", "élan; elan", "見 中村さん", r"odd \e name", "Andrés? no: Andréa")
    listed = gazetteer.gazetteer(spark, {"explicit": names})
    spans = gazetteer.gazetteer_spans(chunk_text(text), listed).orderBy("doc_id", "start").collect()
    want = [(1, "NORA QJJJ"), (1, "ANDRÉ"), (2, "josé álvarez"), (2, "JOSÉ ÁLVAREZ"), (3, "élan"), (4, "中村"), (5, r"odd \e name")]
    assert [(r["doc_id"], r["value"]) for r in spans] == want
    swept, found = gazetteer.sweep_names(redact(chunk_text(text), STRICT), names)
    assert found.count() == 6
    assert swept.where("doc_id = 4").first()["swept_text"].startswith("見 Person ")


def test_review(spark):
    text = docs(spark, "one Nilam Varden\nand nilam varden", "nothing")
    kwic = review.keyword_in_context(chunk_text(text, mode="cell"), "Nilam Varden", 5).orderBy("position").collect()
    assert [(r["position"], r["found"], r["context"]) for r in kwic] == [(4, "Nilam Varden", "one Nilam Varden and "), (21, "nilam varden", " and nilam varden")]
    status = {r["name"]: r["status"] for r in review.name_check(chunk_text(text), gazetteer.gazetteer(spark, SAMPLE_NAMES)).collect()}
    assert status["Nilam Varden"] == "STILL PRESENT" and status["Priya Nair"] == "REDACTED"


class VisibleText(HTMLParser):
    """Text nodes outside scripts, styles and comments, by an independent parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def squeezed(text):
    return re.sub(r"\s", "", text)


def test_no_text_of_a_page_is_lost(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    got = {}
    for r in page_chunks(pages).orderBy("doc_id", "chunk_no").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], "") + squeezed(r["text"])
    for r in pages.collect():
        parser = VisibleText()
        parser.feed(r["html"])
        parser.close()
        assert got.get(r["page_id"], "") == squeezed("".join(parser.parts))


def test_places_on_a_page(spark):
    html = """<title>T</title><h1>Call a@b.org</h1><div>ssn <i>123</i>-45-6789<ul><li>one<li>two</ul></div>loose<script>if (a<b) x("</p>")</script>
<table><tr><th>h1<th>h2<tr><td>a<td>b</table><nav>menu <a href="x">link</a></nav><table><tr><td>out<table><tr><td>in</td></tr></table>rest</td></tr></table>
<footer><p>f</p></footer>tail<!-- gone --><style>p{}"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "a < b")], "page_id bigint, html string")
    got = [(r["kind"], r["table_no"], r["row_no"], r["col_no"], r["text"]) for r in page_chunks(pages).where("doc_id = 1").orderBy("chunk_no").collect()]
    none = (None, None, None)
    assert got == [
        ("paragraph", *none, "T"), ("paragraph", *none, "Call a@b.org"), ("paragraph", *none, "ssn 123-45-6789"), ("paragraph", *none, "one"),
        ("paragraph", *none, "two"), ("paragraph", *none, "loose"), ("cell", 1, 1, 1, "h1"), ("cell", 1, 1, 2, "h2"), ("cell", 1, 2, 1, "a"),
        ("cell", 1, 2, 2, "b"), ("header", *none, "menu  link"), ("cell", 2, 1, 1, "out"), ("cell", 3, 1, 1, "in"), ("paragraph", *none, "rest"),
        ("footer", *none, "f"), ("paragraph", *none, "tail"),
    ]
    assert [r["text"] for r in page_chunks(pages).where("doc_id > 1").collect()] == ["a < b"]


def test_pages_and_sinks(spark, tmp_path):
    html = "<html><header>Top</header><p>A &amp; b <b>c</b></p><ul><li> </li><li>d</li></ul><table><tr><td>e</td></tr></table><footer>End a@x.io</footer>"
    pages = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    got = [(r["location"], r["text"]) for r in page_chunks(pages).select("chunk_no", location().alias("location"), "text").orderBy("chunk_no").collect()]
    assert got == [("section 1 header", "Top"), ("paragraph", "A & b c"), ("paragraph", "d"), ("table 1, row 1, column 1", "e"), ("section 1 footer", "End a@x.io")]
    from quietmark.operators.inventory import inventory

    write_inventory(inventory(page_chunks(pages)), str(tmp_path / "inv"))
    assert spark.read.parquet(str(tmp_path / "inv/counts")).collect()[0]["n"] == 1
    done = redact_documents(docs(spark, "a@x.io").withColumn("source", F.lit("s1")))
    write_redacted(done, str(tmp_path / "out"), ("source",))
    assert spark.read.parquet(str(tmp_path / "out")).first()["redacted_text"] == "person1@example.com"


def test_assembly_order(spark):
    text = "\n".join(f"l{i}" if i % 3 else "" for i in range(30))
    assert assemble(chunk_text(docs(spark, text))).first()["text"] == "\n".join(x for x in text.split("\n") if x)


def test_missing_input_is_an_error(spark):
    import pytest

    from quietmark.sources.tables import table

    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        table(spark, "/root/testdata/sf0.001", "no_such_table")


def word_file(path, body, parts=()):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        links = "".join(f'<Relationship Id="{name}" Target="{name}.xml"/>' for name, _, _ in parts)
        z.writestr("word/_rels/document.xml.rels", f"<Relationships>{links}</Relationships>")
        for name, tag, inner in parts:
            z.writestr(f"word/{name}.xml", f"<w:{tag} {ns}>{inner}</w:{tag}>")


def test_word_files(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = (
        "<w:p><w:r><w:t>Mail a@x.io</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>and b@x.io</w:t></w:r></w:hyperlink></w:p>"
        + p(" ")
        + f"<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr>{p('Organization:')}{p('Lind')}</w:tc><w:tc>{p('a@x.io')}</w:tc></w:tr></w:tbl>"
        + "<w:sectPr><w:headerReference w:type='default' r:id='header1'/><w:footerReference w:type='first' r:id='footer1'/></w:sectPr>"
    )
    word_file(tmp_path / "one.docx", body, [("header1", "hdr", p("Top c@x.io")), ("footer1", "ftr", p("End"))])
    word_file(tmp_path / "two.docx", p("b@x.io"))
    (tmp_path / "note.txt").write_text("not read")
    chunks = word_chunks(spark, str(tmp_path))
    places = chunks.select("doc_id", "chunk_no", location().alias("location"), "text").orderBy("doc_id", "chunk_no").collect()
    assert [(r["location"], r["text"]) for r in places] == [
        ("paragraph", "Mail a@x.io\nand b@x.io"),
        ("table 1, row 1, column 1", "Organization:\nLind"),
        ("table 1, row 1, column 3", "a@x.io"),
        ("section 1 header", "Top c@x.io"),
        ("paragraph", "b@x.io"),
    ]
    done = redact(redaction_scope(chunks), PARITY).chunks.orderBy("doc_id", "chunk_no").collect()
    assert [r["redacted_text"] for r in done] == [
        "Mail person1@example.com\nand person2@example.com",
        "Organization:\nExample Organization 1",
        "person1@example.com",
        "person2@example.com",
    ]
