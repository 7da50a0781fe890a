"""The query catalogue: every operator over whole tables.

Each query takes a session and a folder with the given Parquet tables.  The
corpus is all documents, all conversation turns and one contact card per
customer.  Detector queries use the ``PARITY`` rules in ``cell`` mode, so that
labels may be followed by text on the next line.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietmark.functions import vocab as V
from quietmark.functions.phones import international, numbering_plan
from quietmark.functions.predicates import clean_person, looks_like_person
from quietmark.operators import annotate, audit, entities, gazetteer, inventory, review, structure
from quietmark.operators.detectors import PARITY, STRICT, Rules, detect, only, span_rows
from quietmark.operators.dictionary import DictionaryTable, build_dictionary, value_spans
from quietmark.operators.names import occurrences
from quietmark.operators.overlaps import with_merged
from quietmark.plans.redaction import Redaction, find_merged, redact, redact_documents, redact_each, redact_hashed
from quietmark.session import save_stage, stage_root
from quietmark.sources.cards import CARD_ID_BASE, contact_cards, name_list_sql
from quietmark.sources.chunks import assemble, chunk_text, field_table, location, page_attributes, page_chunks, redaction_scope
from quietmark.sources.sinks import write_inventory, write_redacted
from quietmark.sources.tables import spread, table
from quietmark.streaming.redact import read_texts, redact_stream, write_stream

TURN_ID_BASE = 2_000_000_000
NAMES = V.SAMPLE_NAMES
LISTED = replace(PARITY, explicit_names=NAMES["explicit"], known_names=NAMES["known"])
STRICT_LISTED = replace(STRICT, explicit_names=NAMES["explicit"], known_names=NAMES["known"])
SECRET = "demo"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def turn_id() -> Column:
    return (F.lit(TURN_ID_BASE) + F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("doc_id")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents and conversation turns."""
    turns = table(spark, d, "conversations").select(turn_id(), "text")
    return documents(spark, d).unionByName(spread(turns, "doc_id"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).unionByName(contact_cards(spark, d))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return chunk_text(corpus(spark, d), mode="cell")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return chunk_text(corpus(spark, d))


def lines_and_fields(spark: SparkSession, d: str) -> DataFrame:
    """The whole corpus: cards as two-column tables, documents and turns as lines."""
    return chunk_text(texts(spark, d)).unionByName(field_table(contact_cards(spark, d)))


def big(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def spans_of(detector: str, rules: Rules = PARITY) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return span_rows(detect(cells(spark, d), only(rules, detector))).drop("detector_rank")

    return run


def all_spans(spark: SparkSession, d: str) -> DataFrame:
    return span_rows(detect(cells(spark, d), LISTED))


def merged_rows(rules: Rules) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return span_rows(with_merged(detect(cells(spark, d), rules), rules.overlap), "merged")

    return run


def chunk_scan(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", *big("chunk_no"), "text")


def cell_scan(spark: SparkSession, d: str) -> DataFrame:
    return field_table(contact_cards(spark, d)).select(
        "doc_id", *big("chunk_no", "table_no", "row_no", "col_no"), location().alias("location"), "text"
    )


def page_scan(spark: SparkSession, d: str) -> DataFrame:
    pages = spread(table(spark, d, "pages").select("page_id", "html"), "page_id")
    return page_chunks(pages)


def page_scan_rows(spark: SparkSession, d: str) -> DataFrame:
    return page_scan(spark, d).select("doc_id", *big("chunk_no"), location().alias("location"), "text")


def text_assembly(spark: SparkSession, d: str) -> DataFrame:
    return assemble(lines(spark, d))


def phone_countries(spark: SparkSession, d: str) -> DataFrame:
    """Phones per numbering-plan entry: equi-join on each possible country code."""
    phones = spans_of("phone")(spark, d).select(international(F.col("value")).alias("e164"))
    coded = phones.select("e164", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")).select(
        "e164", F.substring("e164", F.lit(1), F.col("k")).alias("country_code")
    )
    national = F.substring(F.col("e164"), F.length("country_code") + 1, F.length("e164"))
    return (
        coded.join(F.broadcast(numbering_plan(spark)), "country_code")
        .where(F.length(national).between(F.col("nsn_min"), F.col("nsn_max")))
        .where(F.regexp_like(national, F.concat(F.lit("^(?:"), F.col("lead"), F.lit(")"))))
        .groupBy("country_code", "label")
        .agg(F.count("*").alias("n"))
    )


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return entities.title_case_candidates(lines(spark, d))


def name_likeness(spark: SparkSession, d: str) -> DataFrame:
    values = candidates(spark, d).select("text").distinct()
    return values.select(
        F.col("text").alias("value"),
        clean_person(F.col("text")).alias("cleaned"),
        looks_like_person(F.col("text")).alias("is_name"),
    )


def spans_gazetteer(spark: SparkSession, d: str) -> DataFrame:
    return gazetteer.gazetteer_spans(cells(spark, d), gazetteer.gazetteer(spark, NAMES))


def large_list(spark: SparkSession, d: str) -> DataFrame:
    keys = {"customer": table(spark, d, "customer"), "supplier": table(spark, d, "supplier")}
    return spark.sql(name_list_sql("{customer}", "{supplier}"), **keys)


def spans_gazetteer_large(spark: SparkSession, d: str) -> DataFrame:
    """Thousands of names from a table."""
    return gazetteer.gazetteer_spans(cells(spark, d), large_list(spark, d))


def name_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """The same names by their beginnings, as lists too long to broadcast are joined."""
    found = occurrences(cells(spark, d), large_list(spark, d))
    return found.select("doc_id", *big("chunk_no", "start", "end"), "list", "name", "value")


def dictionary(scope: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        merged = save_stage(find_merged(cells(spark, d), LISTED))
        found = build_dictionary(value_spans(merged, LISTED), scope, LISTED)
        keys = ["doc_id"] if scope == "document" else []
        return found.select(*keys, "type", "norm_key", "n", "uses", "replacement")

    return run


def redacted_cells(spark: SparkSession, d: str, rules: Rules = LISTED) -> Redaction:
    return redact(cells(spark, d), rules)


def redacted_chunks(spark: SparkSession, d: str) -> DataFrame:
    return redacted_cells(spark, d).chunks.select("doc_id", *big("chunk_no"), "redacted_text", "n_redactions")


def redacted_chunks_strict(spark: SparkSession, d: str) -> DataFrame:
    done = redact(lines(spark, d), STRICT_LISTED)
    return done.chunks.select("doc_id", *big("chunk_no"), "redacted_text", "n_redactions")


def redacted_pages(spark: SparkSession, d: str) -> DataFrame:
    # The page text is the result of several regular expressions: written once,
    # not repeated in both branches of the flow.
    chunks = save_stage(redaction_scope(page_scan(spark, d)))
    done = redact(chunks, LISTED)
    return done.chunks.select("doc_id", *big("chunk_no"), "redacted_text", "n_redactions")


def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    return redact_documents(corpus(spark, d), LISTED, "document").select("doc_id", "redacted_text", "n_redactions")


def redacted_hashed(spark: SparkSession, d: str) -> DataFrame:
    done = redact_hashed(lines(spark, d), LISTED, secret=SECRET)
    return done.select("doc_id", *big("chunk_no"), "redacted_text", "n_redactions")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark).rstrip('/')}/quietmark-{name}-{uuid.uuid4().hex}"  # fresh in every run


def redacted_sink(spark: SparkSession, d: str) -> DataFrame:
    """The redacted documents as written by source, read back."""
    path, key = fresh_folder(spark, "redacted"), F.col("doc_id")
    done = redacted_documents(spark, d)
    source = F.when(key >= TURN_ID_BASE, "turns").when(key >= CARD_ID_BASE, "cards").otherwise("documents")
    write_redacted(done.withColumn("source", source), path, ("source",))
    return spark.read.parquet(path).select("source", *done.columns)


def inventory_sink(spark: SparkSession, d: str) -> DataFrame:
    """Findings and counts by category as written, read back as one table."""
    path = fresh_folder(spark, "inventory")
    write_inventory(inventory.inventory(lines(spark, d)), path)
    found = spark.read.parquet(f"{path}/findings").withColumn("part", F.lit("findings"))
    counts = spark.read.parquet(f"{path}/counts").withColumn("part", F.lit("counts"))
    return found.unionByName(counts, allowMissingColumns=True)


def stream_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The hashed redaction as one stream over documents, turns and cards."""
    folder, cards = d.rstrip("/"), fresh_folder(spark, "cards")
    contact_cards(spark, d).write.parquet(cards)
    turns = read_texts(spark, f"{folder}/conversations.parquet*", "conv_id bigint, turn bigint, text string").select(turn_id(), "text")
    return streamed(spark, read_texts(spark, f"{folder}/documents.parquet*").unionByName(turns).unionByName(read_texts(spark, cards)))


def streamed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    out = fresh_folder(spark, "stream")
    stream = redact_stream(rows, LISTED, secret=SECRET)
    write_stream(stream, f"{out}/rows", f"{out}/offsets").awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.select("doc_id", *big("chunk_no"), "redacted_text", "n_redactions")


def redacted_entities(spark: SparkSession, d: str) -> DataFrame:
    """Patterns, listed names from a table, and filtered entity candidates."""
    chunks = lines(spark, d)
    found = candidates(spark, d)
    extra = (
        gazetteer.gazetteer_spans(chunks, gazetteer.gazetteer(spark, NAMES))
        .unionByName(entities.filter_people(found, chunks, PARITY))
        .unionByName(entities.filter_organizations(found, PARITY))
    )
    done = redact(chunks, PARITY, extra=extra)
    return done.chunks.select("doc_id", *big("chunk_no"), "redacted_text", "n_redactions")


def redacted_entities_in_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same without a join of chunks and candidates: listed names by the rules, candidates as an array of the row."""
    annotated = annotate.with_entity_spans(lines(spark, d).withColumn("found", annotate.title_case(F.col("text"))), PARITY)
    # Both branches of the flow read the array: written once, as for a function that costs more.
    done = redact(save_stage(annotated), LISTED, found="found")
    return done.chunks.select("doc_id", *big("chunk_no"), "redacted_text", "n_redactions")


def rule_function():
    """What a caller would bring: a function from texts to spans, here the pattern of the stand-in candidates."""
    import re

    pattern = re.compile(entities.TITLE_CASE, re.ASCII)
    terms, generic = V.ORGANIZATION_TERMS, V.GENERIC_ORGANIZATION_WORDS

    def label(value: str) -> str:
        low = value.strip().lower()
        return "ORG" if low not in generic and any(t in low for t in terms) else "PERSON"

    return lambda texts: [[(m.start(), m.end(), label(m.group())) for m in pattern.finditer(t)] for t in texts]


def entities_by_function(spark: SparkSession, d: str) -> DataFrame:
    """A caller's function over overlapping segments: the candidates of the uncut texts."""
    return annotate.candidate_rows(annotate.with_found(lines(spark, d), rule_function, size=400, overlap=160))


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Every redaction with its place, over the whole corpus."""
    done = redact(lines_and_fields(spark, d), LISTED)
    places = done.chunks.where("n_redactions > 0").select("doc_id", "chunk_no", location().alias("location"))
    return done.findings.join(places, ["doc_id", "chunk_no"]).select(
        "doc_id", "location", *big("st", "en"), "type", "value", "replacement"
    )


def redactions_per_document(spark: SparkSession, d: str) -> DataFrame:
    """Every redaction with its place in the document, numbered within it."""
    rows = redact_each(corpus(spark, d), LISTED).select("doc_id", F.explode_outer("redactions").alias("r")).where(F.col("r.st").isNotNull())
    return rows.select("doc_id", F.col("r.st").cast("bigint").alias("start"), F.col("r.en").cast("bigint").alias("end"), "r.type", "r.value", "r.n", "r.replacement")


def deliveries(spark: SparkSession, d: str) -> tuple[DictionaryTable, DataFrame]:
    """Documents and cards, then conversation turns, redacted one after the other with one dictionary that lives on."""
    entries = DictionaryTable(spark, fresh_folder(spark, "entries"), LISTED)
    later, out = F.col("doc_id") >= TURN_ID_BASE, fresh_folder(spark, "deliveries")
    for number, part in ((1, ~later), (2, later)):
        done = redact(cells(spark, d).where(part), LISTED, table=entries, delivery=number).chunks
        done.select("doc_id", *big("chunk_no"), "redacted_text", "n_redactions").write.mode("append").parquet(out)
    return entries, spark.read.parquet(out)


def dictionary_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary after both deliveries, and the first one once more, which adds nothing."""
    entries, _ = deliveries(spark, d)
    entries.extend(value_spans(find_merged(cells(spark, d).where(F.col("doc_id") < TURN_ID_BASE), LISTED), LISTED), 3)
    return entries.entries()


def redacted_hashed_twice(spark: SparkSession, d: str) -> DataFrame:
    """The redacted text redacted again: nothing is left to find."""
    # Written in between, as a second delivery would be: a filter on a computed text is evaluated with the text.
    once = save_stage(redact_hashed(lines(spark, d), STRICT_LISTED, secret=SECRET))
    again = once.select("doc_id", "chunk_no", F.col("redacted_text").alias("text"), F.col("n_redactions").alias("first_redactions"))
    done = redact_hashed(again, STRICT_LISTED, secret=SECRET)
    return done.select("doc_id", *big("chunk_no"), "redacted_text", "first_redactions", "n_redactions")


def redaction_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = value_spans(find_merged(cells(spark, d), LISTED), LISTED)
    return (
        rows.rollup("type")
        .agg(F.count("*").alias("n"))
        .select(F.coalesce("type", F.lit("total")).alias("type"), "n")
        .orderBy("type")
    )


def name_sweep(part: str, numbering: str = "corpus") -> Callable[[SparkSession, str], DataFrame]:
    """Names are left out of detection here, so that the sweep has work to do."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        names = [*NAMES["explicit"], *NAMES["known"]]
        swept, done = gazetteer.sweep_names(redact(cells(spark, d), PARITY, numbering), names, bounded=False, overflow=False)
        if part == "findings":
            return done.select("doc_id", *big("chunk_no"), "original", "replacement")
        return swept.select("doc_id", *big("chunk_no"), "swept_text")

    return run


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return redacted_cells(spark, d).chunks.select("doc_id", "text", "redacted_text")


def survival(exact: bool, rules: Rules) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return audit.survival_report(audit.survivor_rows(pairs(spark, d), rules, exact))

    return run


def survivors(spark: SparkSession, d: str) -> DataFrame:
    return audit.survivor_rows(pairs(spark, d), replace(PARITY, luhn=False)).where("survived").drop("survived")


def corpus_survivors(spark: SparkSession, d: str) -> DataFrame:
    both = pairs(spark, d)
    return audit.corpus_survivors(both, both, PARITY)


def substring_survivors(spark: SparkSession, d: str) -> DataFrame:
    # Read three times: the values, and the places and digit runs of the redacted text; dealt evenly, as places cost much.
    done = redact(lines(spark, d), LISTED).chunks.select("doc_id", "chunk_no", "text", "redacted_text")
    done = save_stage(done.repartition("doc_id", "chunk_no"))
    return audit.substring_survivors(done, done, replace(PARITY, luhn=False))


def attributes(spark: SparkSession, d: str) -> DataFrame:
    return page_attributes(spread(table(spark, d, "pages").select("page_id", "html"), "page_id"))


def ner_people(spark: SparkSession, d: str) -> DataFrame:
    return entities.filter_people(candidates(spark, d), lines(spark, d), PARITY, NAMES["known"]).drop("detector_rank")


def ner_inventory(spark: SparkSession, d: str) -> DataFrame:
    return entities.inventory(candidates(spark, d))


def residual_entities(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in the redacted text, not in the original."""
    after = redacted_cells(spark, d).chunks.select("doc_id", "chunk_no", F.col("redacted_text").alias("text"))
    return entities.residual_entities(entities.title_case_candidates(after))


def numbered(spark: SparkSession, d: str) -> DataFrame:
    return review.numbered_candidates(residual_entities(spark, d))


def structure_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pages and the whole corpus, with sections; apart, since page ids are also document ids."""
    parts = {"page": page_scan(spark, d), "corpus": lines_and_fields(spark, d)}
    pages, rest = (structure.structure_counts(chunks).withColumn("source", F.lit(name)) for name, chunks in parts.items())
    return pages.unionByName(rest)


def name_check(spark: SparkSession, d: str) -> DataFrame:
    left = redacted_cells(spark, d, replace(LISTED, known_names=())).chunks
    after = left.select("doc_id", "chunk_no", F.col("redacted_text").alias("text"))
    return review.name_check(after, gazetteer.gazetteer(spark, NAMES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "chunk_scan": chunk_scan,
    "cell_scan": cell_scan,
    "page_scan": page_scan_rows,
    "page_attributes": lambda s, d: attributes(s, d).select("doc_id", *big("chunk_no"), "attribute", "text"),
    "text_assembly": text_assembly,
    "text_assembly_corpus": text_assembly,
    "spans_email": spans_of("email"),
    "spans_ip": spans_of("ip"),
    "spans_ssn": spans_of("ssn"),
    "spans_card_luhn": spans_of("credit_card"),
    "spans_card_any": spans_of("credit_card", replace(PARITY, luhn=False)),
    "spans_phone": spans_of("phone"),
    "spans_dob": spans_of("dob"),
    "spans_labelled_name": spans_of("labelled_name"),
    "spans_labelled_org": spans_of("labelled_organization"),
    "spans_labelled_address": spans_of("labelled_address"),
    "spans_address_window": spans_of("address_window"),
    "spans_gazetteer": spans_gazetteer,
    "spans_gazetteer_large": spans_gazetteer_large,
    "name_occurrences": name_occurrences,
    "phone_countries": phone_countries,
    "name_likeness": name_likeness,
    "all_spans": all_spans,
    "resolve_overlaps": merged_rows(LISTED),
    "resolve_cover": merged_rows(replace(LISTED, overlap="cover")),
    "dictionary": dictionary("corpus"),
    "dictionary_per_document": dictionary("document"),
    "redacted_chunks": redacted_chunks,
    "redacted_chunks_strict": redacted_chunks_strict,
    "redacted_pages": redacted_pages,
    "redacted_documents": redacted_documents,
    "redacted_hashed": redacted_hashed,
    "redacted_hashed_twice": redacted_hashed_twice,
    "redacted_deliveries": lambda s, d: deliveries(s, d)[1],
    "dictionary_deliveries": dictionary_deliveries,
    "redactions_per_document": redactions_per_document,
    "redacted_entities": redacted_entities,
    "redacted_entities_in_rows": redacted_entities_in_rows,
    "entities_by_function": entities_by_function,
    "redacted_sink": redacted_sink,
    "stream_redacted": stream_redacted,
    "stream_redacted_corpus": stream_redacted,
    "findings": findings,
    "findings_corpus": findings,
    "redaction_counts": redaction_counts,
    "name_sweep": name_sweep("text"),
    "name_sweep_findings": name_sweep("findings"),
    "name_sweep_per_document": name_sweep("text", "document"),
    "name_sweep_findings_per_document": name_sweep("findings", "document"),
    "survival_report": survival(False, replace(PARITY, luhn=False)),
    "survival_report_exact": survival(True, PARITY),
    "survivors": survivors,
    "corpus_survivors": corpus_survivors,
    "substring_survivors": substring_survivors,
    "sensitive_values": lambda s, d: audit.distinct_values(corpus(s, d), PARITY),
    "placeholder_counts": lambda s, d: audit.placeholder_counts(pairs(s, d)),
    "character_counts": lambda s, d: audit.character_counts(pairs(s, d)),
    "residual_values": lambda s, d: audit.residual_values(pairs(s, d), PARITY).orderBy("type", "value"),
    "residual_entities": lambda s, d: residual_entities(s, d).orderBy("label", "value"),
    "pii_inventory": lambda s, d: inventory.inventory(lines(s, d)),
    "page_inventory": lambda s, d: inventory.inventory(page_scan(s, d)),
    "inventory_cards": lambda s, d: inventory.inventory(lines(s, d), ("CREDIT_CARD",)),
    "inventory_phones": lambda s, d: inventory.inventory(lines(s, d), ("PHONE",)),
    "inventory_sink": inventory_sink,
    "inventory_counts": lambda s, d: inventory.counts(inventory.inventory(lines(s, d))),
    "address_inventory": lambda s, d: inventory.address_inventory(lines(s, d)),
    "scan_totals": lambda s, d: inventory.scan_totals(lines(s, d), inventory.inventory(lines(s, d))),
    "ner_filter_person": ner_people,
    "ner_filter_org": lambda s, d: entities.filter_organizations(candidates(s, d), PARITY).drop("detector_rank"),
    "ner_inventory": ner_inventory,
    "segments": lambda s, d: entities.segments(cells(s, d)),
    "numbered_candidates": numbered,
    "important_names": name_check,
    "keyword_in_context": lambda s, d: review.keyword_in_context(cells(s, d), "nilam varden"),
    "structure_counts": structure_counts,
    "structure_counts_corpus": structure_counts,
    "first_paragraphs": lambda s, d: structure.first_paragraphs(lines(s, d)),
    "table_sizes": lambda s, d: structure.table_sizes(field_table(contact_cards(s, d))),
}
