"""One query an operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietmark.llm import language_id, licenses, quality, toxicity
from quietmark.llm.alignment import align
from quietmark.llm.common import Stages, attach, bound_batches, fold, fresh
from quietmark.llm.decontaminate import find_overlaps
from quietmark.llm.licenses import scan_licenses
from quietmark.llm.near_dedup import near_duplicates
from quietmark.llm.packing import pack
from quietmark.llm.runs import periodic
from quietmark.llm.secrets import KINDS, secrets
from quietmark.llm.substring_dedup import substring_dedup
from quietmark.llm.topk import top_k
from quietmark.llm.url_filter import judge
from quietmark.sources import tables


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    bound_batches(spark)
    return tables.table(spark, d, name)


#: Rules of the URL query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_exact_topk(spark: SparkSession, d: str) -> DataFrame:
    return top_k(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, k=5, id_col="vec_id", vector_col="embedding", scale=256)


def op2_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    remainder = fold(F.col("doc_id"), 5)
    model = language_id.fit(docs.where(remainder != 0))
    out = docs.select("doc_id", (remainder == 0).alias("held_out"), language_id.identify(F.col("text"), model).alias("p"))
    return out.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), F.col("p.lang").alias("lang_pred"), "p.score", "p.rejected")


def one_label(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One row a labelled document: 1 where at least half of its non-null labels are."""
    labels = table(spark, d, "labels").where(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
    return labels.groupBy("doc_id").agg((F.avg(name) >= 0.5).cast("long").alias("label"))


def op3_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    remainder = fold(F.col("doc_id"), 3)
    labels = one_label(spark, d, "toxic").where(fold(F.col("doc_id"), 3) != 1)
    model = toxicity.fit(attach(docs, labels, ["doc_id"], "inner", 24), F.col("label"))
    out = docs.select("doc_id", (remainder == 1).alias("held_out"), toxicity.score(docs, F.col("text"), model).alias("p"))
    return out.select(
        "doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "p.score", (F.col("p.score") >= 0.7).cast("int").alias("predicted"), "p.passages"
    )


def op4_minhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = near_duplicates(table(spark, d, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def quality_model(spark: SparkSession, docs: DataFrame, d: str) -> quality.Model:
    """Learned from the labels of documents whose crc32(doc_id as text) modulo 5 is not 0; the others test it."""
    key, label = fresh("labelled"), fresh("label")
    labels = one_label(spark, d, "quality").where(fold(F.col("doc_id"), 5) != 0).toDF(key, label)
    named = docs.withColumn(key, F.col("doc_id").try_cast("long"))
    with Stages(spark) as stages:  # the fit reads them in several jobs
        return quality.fit(attach(named, stages.save(labels), [key], "left", 24), F.col(label))


def op5_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = quality_model(spark, docs, d)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    out = docs.select("doc_id", held_out.alias("held_out"), quality.score(docs, model).alias("p"))
    return out.select("doc_id", "held_out", "p.score", (F.col("p.score") >= quality.KEEP_FROM).alias("kept"), "p.text_score", "p.meta_score")


def op6_license_scan(spark: SparkSession, d: str) -> DataFrame:
    out = scan_licenses(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_decontamination(spark: SparkSession, d: str) -> DataFrame:
    out = find_overlaps(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    dirty = F.size("contamination") > 0
    items = F.array_distinct(F.col("contamination.item_id"))
    return out.select("doc_id", dirty.alias("contaminated"), (~dirty).alias("kept"), items.alias("item_ids"), "contamination")


def op8_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return judge(table(spark, d, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op9_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = substring_dedup(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("dedup.n_words"), F.col("dedup.n_removed"), F.col("dedup.kept_sha256"))


def op10_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_tokenizer_alignment(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    found = secrets(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = table(spark, d, "documents").select("doc_id", found.alias("spans"))
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def with_repetitions(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten (by a hash of its id) repeats some of its own words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = docs.where((h % 10 == 0) & F.col("text").isNotNull()).withColumns({"words": words, "g": g})
    chosen = chosen.withColumn("n", F.size("words")).where("n > 0").withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    chosen = chosen.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.expr("slice(words, a + 1, p)"), 11))  # at most 10 whole periods and a part follow
    text = F.array_join(F.slice(F.concat(F.expr("slice(words, 1, a)"), again), F.lit(1), F.col("n")), " ")
    others = docs.where(~F.coalesce((h % 10 == 0) & F.col("text").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return others.unionByName(chosen.withColumn("text", text).select(*docs.columns))


def op13_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = with_repetitions(table(spark, d, "documents").select("doc_id", "text"))
    out = docs.select("doc_id", periodic(F.col("text")).alias("p"))
    order = F.transform("p.runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("q")))
    out = out.select("doc_id", "p", F.array_max(order).alias("top"))
    line = F.array_join(F.transform("p.runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.select(
        "doc_id",
        F.size("p.runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.q")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.q")).cast("long").alias("exponent_milli"),
        F.sha2(line, 256).alias("runs_sha256"),
        F.sha2("p.kept_text", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_license_scan": op6_license_scan,
    "op7_decontamination": op7_decontamination,
    "op8_url_filter": op8_url_filter,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_secret_scan": op12_secret_scan,
    "op13_periodic_runs": op13_periodic_runs,
}

_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
    for h, p, _ in sorted(URL_RULES, key=lambda r: (-r[0].count("."), -len(r[1])))
)

SQL: dict[str, str] = {
    "op1_exact_topk": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
t AS (SELECT r, vec_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, c.r, sum(q.x * c.x)::BIGINT AS score FROM t q JOIN t c USING (i)
  WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY q.vec_id, q.r, c.vec_id, c.r)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op6_license_scan": licenses.oracle(),
    "op8_url_filter": f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
j AS (SELECT *, CASE {_FITS} END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({", ".join(f"'{h}{p}'" for h, p, v in URL_RULES if v == "block")}) THEN 'block' ELSE 'allow' END AS verdict FROM j""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) > 12),
g AS (SELECT r, doc_id, i, sha256(array_to_string(ws[i:i + 12], ' ')) AS h FROM p),
o AS (SELECT h, min(doc_id) AS m FROM g GROUP BY h),
x AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS j FROM g JOIN o USING (h) WHERE m < doc_id),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM d),
k AS (SELECT r, string_agg(w, ' ' ORDER BY j) AS t FROM w ANTI JOIN x USING (r, j) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM x GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN n USING (r)""",
}
