"""The pipeline's near-dedup against exact Jaccard similarity."""

import random

import pytest

import corpus_pipeline
from tallyforge.llm import near_copies, simhash_dedup

SCHEMA = "doc_id long, text string"
STAGE = dict(corpus_pipeline.STAGES)["near_dedup"]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def copies():
    """30 texts, each with copies at similarities around 0.8, and one group large enough for leaders."""
    rng, out = random.Random(9), []
    word = lambda: f"w{rng.randrange(5000)}"
    for i in range(30):
        base = [word() for _ in range(150)]
        out.append(base)
        for edits in (1, 2, 3, 4, 5, 8):
            t = list(base)
            for at in rng.sample(range(150), edits):
                t[at] = word()
            out.append(t)
        if i == 0:
            for at in range(90):
                out.append([*base[:at], word(), *base[at + 1 :]])
    rng.shuffle(out)
    return [" ".join(t) for t in out]


def components(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def left_of(spark, texts, bucket):
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA).selectExpr("doc_id AS row", "doc_id", "text")
    return sorted(r.row for r in near_copies.heads(rows, bucket).collect())


def pairwise(texts, left):
    """None of those left are near copies, and each group has one."""
    label = components(texts)
    assert {label[i] for i in left} == set(label)
    assert all(similarity(texts[i], texts[j]) < 0.8 for i in left for j in left if i < j)


def test_near_copies_at_the_rule_go(spark):
    texts = copies()
    left = sorted(r.doc_id for r in STAGE(spark, spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3), "").collect())
    pairwise(texts, left)
    assert len(left) < len(texts) / 2


def test_components_where_bands_are_met_in_whole(spark):
    texts = copies()
    assert left_of(spark, texts, 1000) == sorted(set(components(texts)))


def test_leaders(spark):
    texts = copies()
    pairwise(texts, left_of(spark, texts, 2))


@pytest.mark.parametrize("stage", [STAGE, simhash_dedup.stage])
def test_null_and_repeated_ids_lose_only_copies(spark, stage):
    rng = random.Random(11)
    text = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(6)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (7, text[2]), (7, text[3]), (7, text[3]), (None, text[4]), (9, text[4]), (8, text[5]), (6, text[5])]
    got = sorted(map(repr, map(tuple, stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect())))
    assert got == sorted(map(repr, [(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (9, text[4]), (6, text[5])]))


def chain(n):
    """n texts in a chain: each is a near copy of the next, and of few others, so a band of them must be met in whole."""
    rng = random.Random(4)
    words = [f"c{rng.randrange(10**6)}" for _ in range(120 + 3 * n)]
    return [" ".join(words[3 * i : 3 * i + 120]) for i in range(n)]


@pytest.mark.parametrize("block", [8, 1024])
def test_components_do_not_depend_on_blocks(spark, block):
    """A chain, a large group of copies with strays, and texts that share a passage: one document stays of each component, whatever the blocks."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(150)]
    texts = chain(40)
    for i in range(70):
        edits = dict.fromkeys(rng.sample(range(150), 2 if i % 9 else 5), "edited")
        texts.append(" ".join(edits.get(k, w) + (str(i) if k in edits else "") for k, w in enumerate(base)))
    passage = [word() for _ in range(100)]
    texts += [" ".join([*(word() for _ in range(30)), *passage, *(word() for _ in range(30))]) for _ in range(40)]
    rng.shuffle(texts)
    assert left_of(spark, texts, block) == sorted(set(components(texts)))


def test_a_shared_passage_makes_few_pairs(spark):
    """700 texts that have 400 of 650 words in common: all stay, and next to no pair is verified."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(400)]
    texts = [" ".join([*(word() for _ in range(125)), *passage, *(word() for _ in range(125))]) for _ in range(700)]
    asked = []
    whole = near_copies.verified
    try:
        near_copies.verified = lambda pairs, t: asked.append(pairs.count()) or whole(pairs, t)
        assert len(left_of(spark, texts, 1024)) == 700
    finally:
        near_copies.verified = whole
    assert len(asked) == 2 and sum(asked) < 700


def test_candidates_come_from_simhash_too(spark, monkeypatch):
    """op6's fingerprints and multi-index are a step of the stage: without any MinHash candidate, texts that fingerprints bring together still leave one."""
    rng = random.Random(21)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"v{rng.randrange(10**6)}" for _ in range(50))]
    asked = []
    whole = near_copies.simhash_pairs
    monkeypatch.setattr(near_copies, "simhash_pairs", lambda classes: asked.append(classes.count()) or whole(classes))
    monkeypatch.setattr(near_copies, "_met", lambda members, block: spark.createDataFrame([], "a long, b long"))
    assert left_of(spark, texts, 1024) == [0, 2] and asked == [3]
