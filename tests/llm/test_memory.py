"""What operators hold at once, and what workers keep between tasks."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from larkspan.llm import bpe, decontamination, token_files
from larkspan.llm.common import lean


def test_tasks_drop_what_other_modules_keep(monkeypatch):
    monkeypatch.setitem(bpe._WORKER, "x", None)
    monkeypatch.setitem(token_files._WORKER, 1, None)

    def run(batches):
        yield from batches

    run.__module__ = bpe.__name__
    assert list(lean(run)(iter([1]))) == [1]
    assert "x" in bpe._WORKER and not token_files._WORKER
    run.__module__ = decontamination.__name__
    assert list(lean(run)(iter([1]))) == [1] and not bpe._WORKER


def test_regions_are_looked_up_in_bounded_pieces(monkeypatch):
    text = " ".join(f"w{i}" for i in range(300))
    basis = np.random.default_rng(3).standard_normal((decontamination.FEATURES, decontamination.RANK)).astype(np.float32)
    centre = np.zeros(decontamination.RANK, np.float32)
    search = decontamination.Search(decontamination.Items(list(range(40)), [text] * 40, basis, centre), basis, centre)
    possible, most = search._possible, []
    monkeypatch.setattr(search, "_possible", lambda f, low, high, item: most.append(len(item) * int((high - low).max())) or possible(f, low, high, item))
    found = search(pa.RecordBatch.from_arrays([pa.array([text + " end"] * 120)], ["text"]), 0)
    assert set(found) == {(r, i) for r in range(120) for i in range(40)}
    assert len(most) > 1 and max(most) <= 1 << 18


def test_decontamination_stage_is_written(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words that nobody asks for"), (2, "which of these words is the answer to it all")], "doc_id long, text string")
    spark.createDataFrame([(7, "which of these words is the answer to it all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert [r["doc_id"] for r in kept.collect()] == [1] and kept.written_to
