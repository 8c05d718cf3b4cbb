"""Every stage of the pipeline on the small tables, against brute force on the stage's own input."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from lotgrain.llm import chosen_path, fm_index, toxicity, windows
from lotgrain.llm.labelled import remainder
from lotgrain.llm.rows import written
from tests.llm.test_text_operators import SPACED, WORD, hits_by_brute_force, lower, near_by_brute_force, spans_by_brute_force

TABLES = entry_points.SMALL_TABLES
pytestmark = pytest.mark.skipif(not Path(TABLES).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    """The input and the output of each stage but the last, by name."""
    docs, out = spark.read.parquet(f"{TABLES}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, TABLES), name)
        out[name] = (before, docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        if name != "encoding":
            assert after.columns == before.columns and after.dtypes == before.dtypes
            assert after.where(F.col("n_chars") != F.length("text")).count() == before.where(F.col("n_chars") != F.length("text")).count()


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    scores = toxicity.score(before, toxicity.train(before, labels, remainder("doc_id", 3) != 1))
    assert texts(after) == texts(scores.where("toxicity < 0.7"))


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    want = near_by_brute_force(sorted(texts(before).items()), chosen_path.SHINGLE, chosen_path.PERCENT)
    assert set(texts(after)) == {d for d, (n, _, kept) in want.items() if kept or not n}


def test_repeats_are_cut(stages):
    before, after = (texts(x) for x in stages["substrings"])
    ids = sorted(before)
    gone = spans_by_brute_force([before[i] for i in ids], windows.WINDOW)
    assert set(after) == set(ids)
    for i, spans in zip(ids, gone, strict=True):
        kept = [w for k, w in enumerate(SPACED.findall(before[i])) if k not in spans]
        assert SPACED.findall(after[i]) == kept and (spans or after[i] == before[i])


def test_benchmark_passages_are_cut(spark, stages):
    before, after = (texts(x) for x in stages["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    assert set(after) == set(before)
    for i, text in before.items():
        words = WORD.findall(lower(text))
        hit, _ = hits_by_brute_force(words, items, fm_index.WINDOW)
        assert WORD.findall(lower(after[i])) == [w for k, w in enumerate(words) if k not in hit]
        assert hit or after[i] == text


def test_encoding_round_trip(spark, stages):
    before, after = stages["encoding"]
    want = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts(before).items()}
    assert {r.doc_id: r.decoded_sha256 for r in after.collect()} == want
    assert corpus_pipeline.run(spark, TABLES).exceptAll(after).count() == 0


def test_stages_take_odd_rows_and_empty_tables(spark):
    rows = [(None, None, None, "s", None, 1), (1, "", "en", None, 0, 2), (1, "", "en", None, 0, 2), (2, "x y", "de", "s", 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cls int")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, some, TABLES)
            assert got.count() == some.count(), name
            assert name == "encoding" or got.columns == docs.columns
