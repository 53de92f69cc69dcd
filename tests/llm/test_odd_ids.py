"""Null ids, an id that comes with two texts, and repeated rows: every row keeps a result of its own text."""

import zlib
from collections import Counter

import pytest

import corpus_pipeline
from tallyforge.llm import registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that say something of the text alone, whatever the id.
OWN = {"op1_mpegts": "media_sha256", "op2_packing": "ids_crc32", "op3_suffix_tree": "n_tokens", "op4_host_rules": "n_words", "op5_line_dedup": "n_lines", "op6_simhash": "fingerprint", "op7_mixing": "size", "op8_weak_quality": "posterior", "op12_align": "groups_sha256", "op13_repeats": "n_bytes"}


def rows():
    words = lambda k, n: " ".join(f"w{(k * 7 + i * i) % 97}" for i in range(n))
    out = [(i, f"{words(i, 40)}\nline {i}\n") for i in range(12)]
    out += [(None, "no id here\nalpha"), (None, "no id either\nbeta"), (None, None), (5, "another text of five\ngamma"), (5, "another text of five\ngamma"), (3, "")]
    return [(i, t, "en", ("web", None)[k % 2], None if t is None else len(t)) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The same texts under odd ids, and under ids of their own."""
    out = []
    for name, data in (("odd", rows()), ("plain", [(100 + k, *r[1:]) for k, r in enumerate(rows())])):
        at = tmp_path_factory.mktemp(name)
        spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(i, (i or 0) % 2, (i or 0) % 3 == 0) for i in (0, 1, 2, 3, 5, 5, None)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as int) AS toxic").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(None, "http://a.net/x"), (1, None), (1, "http://b.org/fr/"), (None, "no")], "page_id long, url string").write.parquet(f"{at}/pages.parquet")
        out.append(str(at))
    return out


@pytest.mark.parametrize("name", list(OWN))
def test_each_row_has_its_text(spark, tables, name):
    odd, plain = (registry.QUERIES[name](spark, at) for at in tables)
    shown = lambda df: Counter(f"{r[0]:.9f}" if isinstance(r[0], float) else str(r[0]) for r in df.select(OWN[name]).collect())
    assert shown(odd) == shown(plain)
    ids = Counter(r.doc_id for r in odd.select("doc_id").collect())
    assert ids == Counter(r[0] for r in rows())


def test_scores_of_odd_ids(spark, tables):
    got = registry.QUERIES["op9_toxicity"](spark, tables[0]).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows()) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in got)
    urls = registry.QUERIES["op10_url_markov"](spark, tables[0]).collect()
    assert Counter(r.page_id for r in urls) == Counter([None, 1, 1, None])


def test_simhash_component_of_null_ids(spark, tables):
    """Equal fingerprints are one component; its id is the smallest there is, null only if none has one."""
    got = registry.QUERIES["op6_simhash"](spark, tables[0]).collect()
    own = {}
    for r in got:
        own.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(x) == 1 for x in own.values())
    assert {r.component_id for r in got if r.doc_id is not None} <= {r[0] for r in rows() if r[0] is not None}


def test_pipeline_keeps_what_is_no_copy(spark, tables):
    """Of eighteen rows one is an exact copy and one of two empty texts goes; no other row is lost to its id before the mix."""
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    left = stage["near_dedup"](spark, stage["line_dedup"](spark, docs, tables[0]), tables[0])
    texts = Counter(r.text or "" for r in left.collect())
    assert left.columns == docs.columns and texts == Counter({r[1] or "" for r in rows()})
