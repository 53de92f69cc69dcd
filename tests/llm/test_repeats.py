"""Repeated passages against every string of that length counted in a dictionary."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import common, registry, repeats

SCHEMA = "doc_id long, text string, key string, own string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        starts = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), starts, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def texts(length):
    rng = random.Random(length)
    words = [a + b for a in "ka lo mi né ru sa".split() for b in "ta po li du en or 😀".split()]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    out = [prose(rng.randint(1, 120)) for _ in range(40)]
    shared = prose(length // 3)
    for n in (length - 1, length, length + 1, 2 * length, len(shared)):
        out += [prose(20) + shared[:n], shared[:n] + prose(20), prose(5) + shared[:n] + prose(9)]
    near = prose(length)
    for _ in range(25):
        i = rng.randrange(len(near))
        out.append(near[:i] + "#" + near[i + 1 :])
    out += [out[3], out[3], out[4] + "x", "y" + out[4], "x" * (3 * length), "ab" * (2 * length), "ab" * length + "c", None, "", "", "short", "short", "z" * length, "z" * (length - 1)]
    out += [p + shared[: length + 7] + p[::-1] for p in (prose(7) for _ in range(50))]
    return out


@pytest.mark.parametrize(("length", "gram", "most"), [(200, 64, 1 << 14), (200, 64, 3), (40, 8, 1 << 14), (40, 8, 2), (50, 50, 1 << 14), (50, 49, 2)])
def test_removed_bytes(spark, length, gram, most):
    rows = [(i if i % 7 else None, t, "k", "o") for i, t in enumerate(texts(length))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = repeats.remove_repeats(docs, length=length, gram=gram, most=most, block=50).collect()
    shown = [(r.own.doc_id, len((r.own.text or "").encode()), sum(s.end - s.start for s in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert sorted(map(repr, shown)) == sorted(repr((r[0], *x)) for r, x in zip(rows, brute([r[1] for r in rows], length)))


def test_query(spark, tmp_path):
    rows = [(i, t, "k", "o") for i, t in enumerate(texts(200))]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.QUERIES["op13_repeats"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(brute([r[1] for r in rows], 200)))


def test_anchors_are_picked_by_bytes_alone(monkeypatch):
    """Equal strings have an anchor at the same place, wherever they stand, also where a long text is read in windows."""
    grams = repeats.Grams(40, 8)
    rng = random.Random(2)
    data = bytes(rng.choices(range(256), k=3000))
    whole = dict(zip(*(x.tolist() for x in grams.anchors(data))))
    for i in range(0, len(data) - 40, 13):
        own = dict(zip(*(x.tolist() for x in grams.anchors(data[i : i + 40]))))
        assert own and all(whole[i + p] == h for p, h in own.items())
    monkeypatch.setattr(repeats, "STEP", 100)
    assert dict(zip(*(x.tolist() for x in repeats.Grams(40, 8).anchors(data)))) == whole


def test_hashes_move_with_their_grams():
    grams = repeats.Grams(40, 8)
    data = bytes(random.Random(3).choices(range(256), k=5000))
    own = grams.hashes(np.frombuffer(data, np.uint8))
    moved = grams.hashes(np.frombuffer(b"some bytes before" + data, np.uint8))
    assert own.dtype == np.uint64 and (moved[17:] == own).all() and len(np.unique(own)) == len(own)


def test_bitmaps_let_few_anchors_through(spark):
    """Anchors are least hashes, yet a bitmap of others' knows them for none of its own."""
    grams = repeats.Grams(200, 64)
    rng = random.Random(6)
    _, own = grams.anchors(bytes(rng.choices(b"abcdefgh ", k=100_000)))
    _, other = grams.anchors(bytes(rng.choices(b"abcdefgh ", k=100_000)))
    words = common.bitmap(spark.createDataFrame([(int(h),) for h in own], "h long"))
    assert common.marked(words, own).all() and common.marked(words, other).mean() < 0.1


def test_columns_against_comparison():
    rng = random.Random(8)
    segments = [bytes(rng.choices(b"ab", k=rng.randint(5, 20))) for _ in range(60)]
    shift = [rng.randrange(4) for _ in segments]
    got = repeats.columns_repeated(segments, shift, 6)
    at = lambda i, c: segments[i][c - shift[i] : c - shift[i] + 6] if c >= shift[i] else b""
    for c in range(len(got)):
        own = Counter(at(i, c) for i in range(60) if len(at(i, c)) == 6)
        assert [len(at(i, c)) == 6 and own[at(i, c)] > 1 for i in range(60)] == got[c].tolist()
