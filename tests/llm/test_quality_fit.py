"""What the fit of the quality classifier brings to the driver, and how often it goes through the labels."""

import zlib

import numpy as np
import pyarrow as pa

from quietmark.llm import quality, queries
from quietmark.llm.quality import CATEGORIES


def test_categories_are_spread_only_where_they_are_used():
    source, n = ["a", None, "b", "a", ""], [3, None, 0, -7, 12]
    batch = pa.RecordBatch.from_arrays([pa.array([1.0, 0.0, None, 1.0, 0.0]), pa.array(["x y", "", "z", "x", "q"]), pa.array(source), pa.array(n)], names=["y", "text", "m0", "m1"])
    (out,) = quality._features(iter([batch]))
    values = np.array(out["meta"].to_pylist())
    assert values.shape == (5, 3)  # one number a category, two a number
    wanted = np.zeros((5, CATEGORIES + 3))
    for i, (s, x) in enumerate(zip(source, n)):
        wanted[i, CATEGORIES if s is None else zlib.crc32(s.encode()) % CATEGORIES] = 1
        wanted[i, CATEGORIES + 1 :] = (0, 1) if x is None else (np.sign(x) * np.log1p(abs(x)), 0)
    assert (quality.spread(values, [True, False]) == wanted).all()
    assert (quality.meta_features(batch.columns[2:]) == wanted).all()
    assert quality.spread(np.zeros((0, 1)), [True, False]).shape == (0, CATEGORIES + 3)


def test_labels_are_summed_up_once_and_removed(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"words {i} in a line" if i % 3 else f"BAD!! {i} BAD!!", "s", i) for i in range(60)] + [(None, None, None, None)], "doc_id long, text string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(50)] * 2 + [(None, 1), (3, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, fit = [], quality.fit

    def watched(docs, label):
        seen.append((docs._jdf.queryExecution().optimizedPlan().toString(), docs.inputFiles()))
        return fit(docs, label)

    monkeypatch.setattr(quality, "fit", watched)
    docs = queries.table(spark, str(tmp_path), "documents")
    model = queries.quality_model(spark, docs, str(tmp_path))
    ((plan, files),) = seen
    assert "Aggregate" not in plan
    saved = [f for f in files if str(tmp_path) not in f]
    assert saved and all(spark._jvm.java.io.File(f.removeprefix("file://")).exists() is False for f in saved)
    assert model.text is not None and docs.select(quality.score(docs, model).alias("p")).where("p.score is null").count() == 0
