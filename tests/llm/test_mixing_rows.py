"""The mix of rows without ids, of repeated rows, and against every choice of whole documents."""

import itertools
from collections import Counter

import pytest

from tallyforge.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(kind, n=3000):
    word = {"no ids": lambda i: f"w{i}", "one id": lambda i: f"w{i}", "equal rows": lambda i: "w"}[kind]
    size = (lambda i: 7) if kind == "equal rows" else (lambda i: 1 + i * 37 % 200)
    return [(5 if kind == "one id" else None, " ".join([word(i)] * size(i)), "en", "abc"[i % 3] if i % 4 else "a", 1) for i in range(n)]


@pytest.mark.parametrize("kind", ["no ids", "one id", "equal rows"])
def test_targets_are_met_whatever_the_ids(spark, tmp_path, kind):
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows(kind), SCHEMA).repartition(5).write.parquet(at)
    ask = lambda: mixing.op7_mixing(spark, str(tmp_path))
    got = ask().collect()
    taken, target = Counter(), {}
    for r in got:
        key = (r.source_size, r.target)
        taken[key] += r.taken
        target[key] = r.target
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    assert len(target) == 3 and all(abs(taken[s] - target[s]) <= 200 for s in target)
    assert Counter(map(tuple, got)) == Counter(map(tuple, ask().collect()))
    out = Counter((r.text, r.source) for r in mixing.stage(spark, spark.read.parquet(at), "").collect())
    assert sum(len((t or "").split()) * n for (t, _), n in out.items()) == sum(taken.values())


def test_taken_against_every_choice(spark):
    """Of a small source that fills its target once the words taken come as near as the best prefix of hashes filled up by up to three: no single swap in or out comes nearer than the largest document."""
    data = [(i, "w " * n, "en", s, 1) for i, (s, n) in enumerate([*(("a", n) for n in (3, 5, 8, 13, 21)), *(("b", n) for n in (2, 4, 30, 40))])]
    docs = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix(mixing._sized(docs)).select("source", "_size", "_times", "_target").collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        sizes, target = [r["_size"] for r in own], own[0]["_target"]
        whole = min(3, int(target // sum(sizes)))
        sums = {sum(c) + whole * sum(sizes) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k)}
        best, taken = min(abs(x - target) for x in sums), sum(r["_size"] * r["_times"] for r in own)
        assert taken in sums and best <= abs(taken - target) <= best + min(sizes)
