"""What Python workers hold: the pipeline's workers share an executor's memory with its heap and go from stage to stage."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tallyforge.llm import packing, toxicity


@pytest.fixture
def model():
    return toxicity.Model(3)


def test_only_texts_and_scores_travel(spark, model):
    docs = spark.createDataFrame([(i, None if i == 3 else f"word{i} other", "x" * 9) for i in range(40)] + [(7, "", None)], "doc_id long, text string, rest string")
    out = toxicity.score_documents(docs, model)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    expected = toxicity.Scorer(model).scores([(r.text or "").encode() for r in docs.collect()])
    assert np.allclose([r.score for r in out.collect()], expected, atol=1e-5)
    assert sorted(map(str, out.select("own.*").collect())) == sorted(map(str, docs.collect()))
    kept = out.where("score < 0.5").select("own.*")._jdf.queryExecution().executedPlan().toString()
    assert kept.count("ArrowEvalPython") == 1
    assert {r.score for r in toxicity.score_documents(docs, None).collect()} == {0.0} and toxicity.score_documents(docs.limit(0), model).count() == 0


def test_new_words_take_little_at_a_time(model):
    """30,000 words at once: their features one by one, and no second copy of what is known."""
    text = " ".join(f"w{i}" for i in range(30_000)).encode()
    scorer = toxicity.Scorer(model)
    tracemalloc.start()
    scorer.ids(text.decode().split())
    scorer.ids(text.decode().replace("w", "v").split())
    held = sum(x.nbytes for x in scorer.taps)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held == 6 * toxicity.REMEMBERED * toxicity.FILTERS * 4 and peak - held < 20_000_000
    again = toxicity.Scorer(model)
    for i in range(0, 30_000, 1000):  # the same, however words arrive
        again.ids([f"w{k}" for k in range(i, i + 1000)])
    at = [(scorer.known[w], again.known[w]) for w in ("w0", "w999", "w1000", "w8191", "w8192", "w29999")]
    assert all(np.allclose(scorer.taps[t][a], again.taps[t][b], atol=1e-6) for t in range(6) for a, b in at)


def test_packing_leaves_no_words_behind(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([f"some{i} words{i} here" for i in range(2000)])], ["doc_id", "text"])
    run = packing._pieces(packing.VOCABULARY, packing.CAPACITY, packing.CLOSING)
    rows = sum(b.num_rows for b in run(iter([batch])))
    words = packing._words_of(public_tokenizers.path(packing.VOCABULARY))
    assert rows == 2000 and not words and not words.before and not words.pretokens
