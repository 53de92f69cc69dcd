"""The Merkle manifest against trees built in one list, and its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from tallyforge.llm import merkle, registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, part string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def brute(rows):
    by = {}
    for doc, text, lang, source, n, *_ in rows:
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        plain, changed = (sha("".join(map(field, (doc, source, lang, n, t)))) for t in (text, low))
        hit = zlib.crc32(b"" if doc is None else str(doc).encode()) % 5 == 0
        by.setdefault(source, []).append((doc, plain, changed if hit else plain))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: levels([x[1] for x in by[s]]) for s in names}
    top, out = levels([trees[s][-1][0] for s in names]), []
    for t, s in enumerate(names):
        for i, (doc, leaf, fold) in enumerate(by[s]):
            proof = ""
            for tree, at in ((trees[s], i), (top, t)):
                for level in tree[:-1]:
                    run, k = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    proof, fold, at = proof + "".join(run[:k] + run[k + 1 :]), sha("".join(run[:k]) + fold + "".join(run[k + 1 :])), at // 16
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], sha(proof), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def made(kind):
    rng = random.Random(5)
    row = lambda i, s: (i, rng.choice(["Some Text", "no capitals", "", None, "é ß İ 😀", "Long " * 2000]) if i % 3 else f"T{i}", rng.choice(["en", None]), s, rng.choice([None, i]), "x", "y")
    if kind == "lone":
        return [row(7, "a")]
    if kind == "one source":
        return [row(i, None) for i in range(300)]
    if kind == "many sources":
        return [row(i, f"s{i % 290}é") for i in range(600)]
    sizes = {"a": 1, "b": 16, "c": 17, "B": 257, "": 33, None: 4, "hot": 1500}
    out = [row(i, s) for s, n in sizes.items() for i in range(n)]
    return out + [out[40]] * 3 + [(None, f"N{i}", None, "b", None, "", "") for i in range(5)]


@pytest.mark.parametrize("kind", ["lone", "one source", "many sources", "mixed"])
def test_manifest(spark, tmp_path, kind):
    rows = made(kind)
    random.Random(1).shuffle(rows)
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(at)
    got = sorted(map(tuple, registry.QUERIES["op11_merkle"](spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/*.parquet'")
    sql = con.sql(merkle.SQL)
    order = [sql.columns.index(c) for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")]
    assert sorted((tuple(r[i] for i in order) for r in sql.fetchall()), key=repr) == got


def test_merging_in_any_order_gives_one_root():
    """The merge is associative: nodes dealt to fragments at random give the same runs and root."""
    leaves = [sha(str(i)) for i in range(1000)]
    tops = [sha(f"t{i}") for i in range(20)]
    nodes = [(0, 0, 0, i, 1000, d) for i, d in enumerate(leaves)] + [(0, t, 0, 0, 1, tops[t]) for t in range(1, 20)]
    expected = levels([levels(leaves)[-1][0], *tops[1:]])[-1][0]
    for seed in range(3):
        rng = random.Random(seed)
        parts = [[] for _ in range(7)]
        for n in nodes:
            rng.choice(parts).append(n)
        runs = 0
        while True:
            waiting = []
            for p in parts:
                f = merkle.Forest(20)
                for n in p:
                    f.add(*n)
                rows = [r for b in f.batches(last=True) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                runs += sum(r[6] is not None for r in rows)
                waiting.append([r[:6] for r in rows if r[6] is None])
            if len(waiting) == 1:
                break
            parts = [sum(waiting[i : i + 2], []) for i in range(0, len(waiting), 2)]
        assert [r[5] for r in waiting[0]] == [expected] and runs == 63 + 4 + 1 + 2 + 1
