"""Operators on a small table that has every odd case, against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import common, host_rules, line_dedup, mixing, mpegts, packing, registry, simhash_dedup, suffix_tree_lm, toxicity, url_filter, weak_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(3)
    words = [a + b for a in "ka lo mi ne ru sa".split() for b in "ta po li du en or".split()]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [sentence(rng.randint(5, 120)).capitalize() + ".\n" + sentence(20) + "." for _ in range(60)]
    shared = "Terms apply to every page of this site and all its parts."
    out[:14] = [t + "\n  " + (shared.upper() if i % 2 else shared) + " \n" for i, t in enumerate(out[:14])]
    out += [out[20], out[20], out[21] + " extra", out[21].replace("ka", "lo", 1)]
    out += [None, "", " \t\n\r ", "a", "one two", "\n\n\n", "é" * 50, " ", "x\x0by\x1cz", "same same same same " * 40, "Long " * 30_000, "don't 'S ½ ² ß İ  <|endoftext|> end", "😀 wörld ﬁ ñ"]
    return out


def frame(spark, rows=None):
    rows = [(i, t, ("en", "fr", None)[i % 3], ("web", "web", "web", "books", None)[i % 5], len(t or "")) for i, t in enumerate(texts())] if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of the same layout as the driver's; rows 3 and 4 come twice and there are columns of other names."""
    at = tmp_path_factory.mktemp("tables")
    docs = frame(spark)
    docs = docs.union(docs.where("doc_id IN (3, 4)")).withColumns({n: F.lit("clash") for n in ("row", "hash", "_text", "_at", "print", "score", "key", "own", "_head", "_times", "label")})
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 4 != 0, int(i % 6 == 0)) for i in range(60)], "doc_id long, quality boolean, toxic int").write.parquet(f"{at}/labels.parquet")
    urls = [f"https://{h}.example.{t}/{p}/{i}.html?x#y" for i in range(30) for h in ("a", "WWW.b") for t, p in (("net", "en"), ("net", "de"), ("com", "de"), ("org", "fr"), ("org", "en"), ("com", "en"))]
    urls += [None, "", "no-scheme", "http://", "http://net", "http://NET/", "http://É.net/x", "a://b://c/d", "http://x.org/fr", "http://xexample.net/en/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").union(spark.createDataFrame([(None, urls[0])], "page_id long, url string")).withColumn("host", F.lit("clash")).write.parquet(f"{at}/pages.parquet")
    return str(at)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at)


def rows_of(folder):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text", "source"]).to_pylist()
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in t]


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).collect() == []


def test_mpegts(spark, folder):
    got = registry.QUERIES["op1_mpegts"](spark, folder).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows_of(folder))
    for doc, text, _ in rows_of(folder):
        payload = mpegts.padded(text.encode())
        r = by[doc]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(text.encode()), len(payload), zlib.crc32(payload[-16:])) and r.payload_bytes % 192 == 0
        assert r.payload_sha256 == __import__("hashlib").sha256(payload).hexdigest() and r.media_bytes % 188 == 0
        assert sum(p.length for p in r.points) == len(payload) and r.points[0].random_access


def test_mpegts_damage():
    payload = bytes(range(256)) * 90
    media = mpegts.mux(payload, first_pts=(1 << 33) - 5000)
    out, info, points = mpegts.demux(media)
    assert out == payload and info["cc_errors"] == 0 and points[1][0] == (1 << 33) - 1400 and points[2][0] == 2200
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    lost = next(i for i, p in enumerate(packets) if not p[1] & 0x40 and p[2] == 0 and i > 5)
    out, info, _ = mpegts.demux(b"".join(packets[:lost] + packets[lost + 1 :]))
    assert info["cc_errors"] == 1 and info["pes_damaged"] == 1 and len(out) == len(payload) - mpegts.UNIT
    out, info, _ = mpegts.demux(b"".join(packets[: lost + 1] + packets[lost:]))
    assert out == payload and info["duplicates"] == 1
    out, info, _ = mpegts.demux(b"junk" + media[:1880] + b"xx" + media[1880:])
    assert info["bytes_lost"] == 6 and out == payload
    bad = bytearray(media)
    for i in range(0, len(bad), 188):
        if bad[i + 1] & 0x1F == 0 and bad[i + 2] == 0:
            bad[i + 10] ^= 1
    assert mpegts.demux(bytes(bad))[0] == b"" and mpegts.demux(bytes(bad))[1]["crc_errors"] > 0
    for junk in (b"", b"G", b"G" * 188, bytes(1000)):
        assert mpegts.demux(junk)[0] == b""


def test_packing(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    expected = Counter()
    for doc, text, _ in rows_of(folder):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expected[doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = registry.QUERIES["op2_packing"](spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    ends: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= -(-sum(r.length for r in got) // 4096) + 1


def test_genetic_steps():
    rng = random.Random(1)
    lengths = [rng.randint(1, 70) for _ in range(200)]
    a, b = packing._start(lengths, 100, 2, rng)
    people, done, gains = packing.evolve([a, b], lengths, 100, 10, rng)
    for bins in (packing.crossover(a, b, lengths, 100, rng), packing.mutate(a, lengths, 100, rng), *people):
        assert sorted(i for x in bins for i in x) == list(range(200)) and all(sum(lengths[i] for i in x) <= 100 for x in bins)
    assert len(people[0]) <= len(a) and 0 < done <= 10 and 0 <= gains <= done
    # A packing that can be no better ends the evolution, and nothing else does.
    assert packing.evolve([[[0, 1], [2]]], [60, 40, 70], 100, 10, rng)[1] == 0 and packing.best_possible([60, 40, 70], 100) == (-2, 1 + 0.7**2)
    child = packing.crossover([[0, 1], [2, 3], [4]], [[0, 2], [1, 3], [4]], [50, 50, 50, 50, 10], 100, random.Random(2))
    assert any(sorted(x) in ([0, 1], [2, 3]) for x in child)


def test_islands_beat_best_fit(spark):
    """Lengths cut from full sequences, three of each: best fit in falling order takes more sequences than the islands."""
    rng, lengths = random.Random(3), []
    for _ in range(60):
        a = rng.randint(900, 1800)
        b = rng.randint(900, min(1800, 4096 - a - 900))
        lengths += [a, b, 4096 - a - b]
    rng.shuffle(lengths)
    plain = packing.best_fit([], sorted(range(180), key=lambda i: -lengths[i]), lengths, 4096)
    items = spark.createDataFrame(list(enumerate(lengths)), "row long, length long")
    state = packing.islands_of(items, 4096, 4096, 3).collect()
    assert min(max(r.people[0]) + 1 for r in state) < len(plain)
    assert len(state) == 3 and all(r.crossovers == packing.EPOCHS * packing.GENERATIONS for r in state) and sum(r.gains for r in state) > 0


def test_shards_and_islands(spark):
    items = spark.range(3000).select(F.col("id").alias("row"), (F.pmod(F.hash("id"), F.lit(90)) + 1).cast("long").alias("length"))
    got = packing.pack(items, capacity=100, shard=500).join(items, "row").groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count(F.lit(1)).alias("c")).collect()
    assert sum(r.c for r in got) == 3000 and all(r.n == r.end <= 100 for r in got)
    # In shards it comes as near as best fit in falling order over all pieces at once.
    lengths = [r.length for r in items.collect()]
    assert len(got) <= 1.02 * len(packing.best_fit([], sorted(range(3000), key=lambda i: -lengths[i]), lengths, 100))


def test_suffix_tree(spark, folder):
    rows = rows_of(folder)
    train, total = Counter(), 0
    tokens = lambda t: [*t.encode().lower().split(), b"\n"]
    for doc, text, _ in rows:
        if zlib.crc32(str(doc).encode()) % 7 != 2:
            train.update(tokens(text))
            total += len(tokens(text))
    got = {r.doc_id: r for r in registry.QUERIES["op3_suffix_tree"](spark, folder).collect()}
    for doc, text, _ in rows:
        r, w = got[doc], tokens(text)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in train for x in w), total, zlib.crc32(str(doc).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((train[x] + 1) / (total + len(train) + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0


def brute_tree(train, depth=3, least=4, discount=0.75, cost=3.0):
    """log10 probability of a text by a suffix tree that is grown from dictionaries, straight from the definition."""
    tokens = lambda t: ["<s>", *t.encode().lower().split(), b"\n"]
    count = [Counter() for _ in range(depth + 2)]  # of n-grams
    for t in train:
        w = tokens(t)
        for n in range(1, depth + 2):
            count[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    words = {k: n for k, n in count[1].items() if k != ("<s>",)}
    total = sum(words.values()) + len(words) + 1
    after = {}
    for n in range(2, depth + 2):
        for g, k in count[n].items():
            if k >= least:
                after.setdefault(g[:-1], {})[g[-1]] = k
    rest = {c: (count[len(c)][c] - sum(s.values()) + discount * len(s)) / count[len(c)][c] for c, s in after.items()}

    def p(w, c, known):
        while c and c not in known:
            c = c[1:]
        if not c:
            return (words.get((w,), 0) + 1) / total
        return max(after[c].get(w, 0) - discount, 0) / count[len(c)][c] * (w in after[c]) + rest[c] * p(w, c[1:], known)

    kept = set()
    for c, s in after.items():
        gain = sum(k * math.log(p(w, c, after) / p(w, c[1:], after)) for w, k in s.items()) + (count[len(c)][c] - sum(s.values())) * math.log(rest[c])
        if gain > len(s) + cost:
            kept |= {c[i:] for i in range(len(c))}

    def score(t):
        own = tokens(t)
        return sum(math.log10(p(w, tuple(own[max(0, i - depth) : i]), kept)) for i, w in enumerate(own) if i)

    return kept, score, p


@pytest.mark.parametrize("hot", [0, 40, 1 << 20])
def test_suffix_tree_against_brute_force(spark, folder, hot):
    # After "q r s" the last word decides with two before it, so depth three tells more than two.
    more = [f"{a} {b} {c} {'one' if a == b else 'two'} ." for a in "qr" for b in "qr" for c in "st"] * 12
    rows = rows_of(folder) + [(1000 + i, t, None) for i, t in enumerate(more)]
    train = [t for doc, t, _ in rows if zlib.crc32(str(doc).encode()) % 7 != 2]
    kept, score, _ = brute_tree(train)
    docs = spark.createDataFrame([(doc, t) for doc, t, _ in rows], "doc_id long, text string").repartition(3)
    docs = common.cut(docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 7 == 2), "docs")
    # With nothing broadcast, with a little, and with everything.
    tree = suffix_tree_lm.grow(docs.where("NOT held_out").select(common.raw("text").alias("text")))
    assert Counter(r.depth for r in tree.contexts.collect()) == Counter(map(len, kept)) and {len(c) for c in kept} == {1, 2, 3}
    for r in suffix_tree_lm.score_with(docs, tree, hot=hot).collect():
        text = next(t for doc, t, _ in rows if doc == r.doc_id)
        assert math.isclose(r.score, score(text), rel_tol=1e-7), r.doc_id


def test_suffix_tree_sums_to_one():
    train = ["a b c . a b d . x b e . " * 40, "a b c"]
    kept, _, p = brute_tree(train)
    words = {*(w for t in train for w in t.encode().split()), b"\n", b"unseen"}
    for c in kept:
        assert math.isclose(sum(p(w, c, kept) for w in words), 1)


def test_parts_of_a_text():
    """Texts cut into parts have the words, hashes and n-grams that they have whole."""
    rng = random.Random(5)
    data = [" ".join(rng.choice(["ab", "c", "Longer", "é", "x" * 90]) + rng.choice(["", "\n", " \t"]) for _ in range(n)) for n in (0, 1, 40, 0, 3, 300, 1)] + ["   ", "y" * 500]
    texts = pa.array([t.encode() for t in data], pa.binary())
    whole, small = suffix_tree_lm.Reader(3), suffix_tree_lm.Reader(3, 64)
    assert (suffix_tree_lm._BYTES[ord("A")] == suffix_tree_lm._BYTES[ord("a")]) and len(set(suffix_tree_lm._BYTES.tolist())) == 230

    def seen(reader, array):
        out = Counter()
        for p in reader.parts(array):
            for d, h in enumerate(suffix_tree_lm.grams(p, 3)):
                ok = p.place >= d
                ok[: p.old] = False
                out.update((d, t, x) for t, x in zip(p.text[ok].tolist(), h[ok].tolist(), strict=True))
        return out

    found = seen(whole, texts)
    assert found == seen(small, texts) and found == Counter({(d, t - 2, x): n for (d, t, x), n in seen(small, pa.concat_arrays([texts[:2], texts])).items() if t > 1})
    for i, t in enumerate(data):
        assert sum(n for (d, text, _), n in found.items() if d == 0 and text == i) == len(t.split()) + 2
    assert len({x for d, _, x in found if d == 0}) == len({w for t in data for w in t.encode().lower().split()}) + 2


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    every = np.array([r.key for r in keys.collect()]).view(np.uint64)
    for blocks in (1, 64, 1 << 22):
        known = suffix_tree_lm.filter_of(keys, 20_000, blocks)
        assert known.maybe(every).all()
    others = np.random.default_rng(1).integers(0, 1 << 64, 20_000, np.uint64)
    assert known.maybe(others).mean() < 0.05
    assert suffix_tree_lm.longer(np.array([5], np.uint64), np.array([7], np.uint64)).view(np.int64)[0] == spark.range(1).select(F.xxhash64(F.lit(5).cast("long"), F.lit(7).cast("long"))).first()[0]


def test_host_rules(spark, folder):
    got = {r.doc_id: r for r in registry.QUERIES["op4_host_rules"](spark, folder).collect()}
    for doc, text, _ in rows_of(folder):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(grams)
        at = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(at) > 50 * len(words)
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(at), failed)
        assert not (r.kept and r.base_failed)


def test_hosts_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "### " * 60
    rows = [(i, good, "en", "a", 1) for i in range(40)] + [(100 + i, bad, "en", "b", 1) for i in range(40)] + [(200, bad, "en", "c", 1)] + [(300 + i, good, "en", f"h{i}", 1) for i in range(20)]
    out = host_rules.judge(frame(spark, rows)).groupBy("host").agg(F.max("host_rejected").alias("x")).collect()
    rejected = {r.host for r in out if r.x}
    assert "b" in rejected and "a" not in rejected


def test_line_dedup(spark, folder):
    rows = rows_of(folder)
    keys = lambda t: [k.strip(b" \t\n\x0b\x0c\r").lower() for k in t.encode().split(b"\n")]
    seen = Counter(k for doc, ks in {doc: set(keys(t)) for doc, t, _ in rows}.items() for k in ks)
    common = {k for k, n in seen.items() if k and n >= 10}
    assert common
    got = {r.doc_id: r for r in registry.QUERIES["op5_line_dedup"](spark, folder).collect()}
    for doc, t, _ in rows:
        kept = [x for x, k in zip(t.encode().split(b"\n"), keys(t), strict=True) if k not in common]
        assert (got[doc].n_lines, got[doc].n_dropped) == (len(keys(t)), len(keys(t)) - len(kept)) and got[doc].kept_sha256 == __import__("hashlib").sha256(b"\n".join(kept)).hexdigest()


def reachable(prints):
    """Smallest index within two bits of each other, by brute force."""
    x = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    label = np.arange(len(prints))
    while True:
        new = np.array([label[x[i]].min() for i in range(len(prints))])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def test_simhash(spark, folder):
    rows = sorted({(d, t) for d, t, _ in rows_of(folder)})
    prints = np.array([simhash_dedup.fingerprint(t.encode()) for _, t in rows], np.uint64)
    label = reachable(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.QUERIES["op6_simhash"](spark, folder).collect()}
    assert got == {d: (f"{p:016x}", rows[c][0]) for (d, _), p, c in zip(rows, prints, label, strict=True)}
    assert len(set(label.tolist())) < len(rows)


@pytest.mark.parametrize("bucket", [0, 2, 64])
def test_near_links_whatever_the_buckets(spark, bucket):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = [np.uint64(1 << int(b)) for b in rng.integers(0, 64, 150)]
    near = [base[i % 3] ^ f for i, f in enumerate(flips)] + [base[i % 12] ^ f ^ flips[-i] for i, f in enumerate(flips)]
    prints = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    roots = {r.node: r.root for r in common.links_to_components(simhash_dedup.near_links(df, bucket)).collect()}
    signed = prints.view(np.int64).tolist()
    label = reachable(prints)
    groups = lambda of: sorted(sorted(i for i in range(len(prints)) if of(i) == g) for g in {of(i) for i in range(len(prints))})
    assert groups(lambda i: roots.get(signed[i], signed[i])) == groups(lambda i: label[i])


def test_mixing(spark, folder):
    got = registry.QUERIES["op7_mixing"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, registry.QUERIES["op7_mixing"](spark, folder).collect()))
    source = {d: s for d, _, s in rows_of(folder)}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert set(sizes) == {"web", "books", None} and math.isclose(sum(target.values()), sum(sizes.values()))
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]]


def test_targets_and_flow():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 187.5, "b": 75.0, None: 37.5}
    capped = mixing.targets({"a": 10, "b": 100, "c": 100})
    assert capped["a"] == 30 and math.isclose(capped["b"], 120) and math.isclose(sum(capped.values()), 210)
    # Overlap: what both may take goes to whom it spares a repetition.
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20.0, "b": 10.0})
    assert all(math.isclose(v, 10) for v in flow.values())
    flow = mixing.min_cost_flow({("a",): 10}, {"a": 25.0})
    assert math.isclose(flow["a",], 25)
    assert mixing.min_cost_flow({("a",): 10}, {"a": 99.0})["a",] == 30


@pytest.mark.parametrize("seed", range(8))
def test_flow_is_cheapest(seed):
    """Overlapping sources, against every flow in whole tokens."""
    import itertools

    rng = random.Random(seed)
    patterns = rng.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "b", "c")], 3)
    capacity = {p: rng.randint(1, 3) for p in patterns}
    quota = {s: float(rng.randint(0, 5)) for s in "abc"}
    got = mixing.min_cost_flow(capacity, quota)
    cost = lambda take: sum(2 * (i // capacity[p]) + 1 for p, n in take.items() for i in range(n))

    def fits(take):  # by Hall's condition on sets of patterns
        return all(sum(take[p] for p in some) <= sum(quota[s] for s in set().union(*some)) for k in range(1, 4) for some in itertools.combinations(patterns, k))

    every = [dict(zip(patterns, n, strict=True)) for n in itertools.product(*(range(3 * capacity[p] + 1) for p in patterns))]
    every = [t for t in every if fits(t)]
    most = max(sum(t.values()) for t in every)
    best = min(cost(t) for t in every if sum(t.values()) == most)
    assert math.isclose(sum(got.values()), most, abs_tol=1e-6)
    whole = {p: round(n) for p, n in got.items()}
    assert all(math.isclose(n, whole[p], abs_tol=1e-6) for p, n in got.items()) and fits(whole) and cost(whole) == best


def test_flow_over_many_patterns():
    import time

    rng, sources = random.Random(4), [f"s{i}" for i in range(40)]
    capacity = {tuple(sorted(rng.sample(sources, rng.randint(1, 3)))): rng.randint(1, 1000) for _ in range(4000)}
    size = {s: sum(n for p, n in capacity.items() if s in p) for s in sources}
    began = time.time()
    got = mixing.min_cost_flow(capacity, mixing.targets(size))
    assert time.time() - began < 20 and all(0 <= got[p] <= 3 * capacity[p] + 1e-6 for p in capacity)
    assert sum(got.values()) <= sum(size.values()) + 1e-3


def test_mixing_of_overlapping_sources(spark):
    """Documents of several sources at once: each source's share of the flow is met within its documents' sizes, reruns agree, and none is above three times."""
    rows = [(str(i), 1 + i % 7, [["a"], ["b"], ["a", "b"], ["b", "c"], ["c", None]][i % 5]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "_key string, _size long, _sources array<string>")
    got = sorted((r._key, r._times, r._size) for r in mixing.mix(docs).collect())
    assert got == sorted((r._key, r._times, r._size) for r in mixing.mix(docs.repartition(7)).collect()) and len(got) == 2000
    assert all(0 <= t <= 3 for _, t, _ in got)
    capacity, total = Counter(), sum(n for _, n, _ in rows)
    for _, n, s in rows:
        capacity[tuple(sorted(s, key=lambda x: (x is None, x or "")))] += n
    size = {s: sum(n for p, n in capacity.items() if s in p) for s in ("a", "b", "c", None)}
    flow = mixing.min_cost_flow(dict(capacity), {s: t * total / sum(size.values()) for s, t in mixing.targets(size).items()})
    taken = Counter()
    for (key, times, n), (_, _, s) in zip(got, sorted(rows), strict=True):
        taken[tuple(sorted(s, key=lambda x: (x is None, x or "")))] += times * n
    # Of several cheapest flows either may be taken; all take as much, and whole documents come within one of it.
    assert abs(sum(taken.values()) - sum(flow.values())) <= 7 * len(flow) and all(taken[p] <= 3 * capacity[p] for p in flow)


def test_mixing_comes_near(spark):
    rows = [(i, "w " * (1 + i * 37 % 200), "en", "abc"[i % 3] if i % 4 else "a", 1) for i in range(3000)]
    out = mixing.mix(mixing._sized(frame(spark, rows)).select("doc_id", "source", "_key", "_size", "_sources"))
    got = out.groupBy("source").agg(F.sum(F.col("_size") * F.col("_times")).alias("t"), F.first("_target").alias("x")).collect()
    assert all(abs(r.t - r.x) < 0.002 * r.x for r in got)


def test_weak_quality(spark, folder):
    got = {r.doc_id: r for r in registry.QUERIES["op8_weak_quality"](spark, folder).collect()}
    assert all(0 <= r.posterior <= 1 and 0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got.values())
    assert got[64].score == got[65].score == got[66].score


def test_quality_scores_by_definition(spark, folder):
    """Posterior and score of each row from the fitted model, written out feature by feature; a text without words is not kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels, w, bias = weak_quality.fit(docs)
    for r in weak_quality.judge(docs).collect():
        text = next(t for doc, t, _ in rows_of(folder) if doc == r.doc_id).encode()
        votes, words = weak_quality.votes(text), text.split()
        odds = math.log(labels.prior / (1 - labels.prior))
        if any(v != weak_quality.ABSTAIN for v in votes):
            odds += sum(math.log(labels.shares[k, 1, v] / labels.shares[k, 0, v]) for k, v in enumerate(votes))
        assert math.isclose(r.posterior, 1 / (1 + math.exp(-max(-50, min(50, odds)))), rel_tol=1e-9)
        if words:
            z = bias + sum(w[i] for x in words for i in weak_quality.word_features(x)) / len(words) + w[weak_quality.variety_feature(words)]
            assert math.isclose(r.score, 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9)
        else:
            assert math.isclose(r.posterior, labels.prior, rel_tol=1e-9) and r.score == 0 and not r.kept
        k, x = weak_quality.shares_of(text)
        assert not words or math.isclose(float(w[k] @ x) + bias, z, rel_tol=1e-9)


def test_label_model_finds_the_classes():
    rng = np.random.default_rng(2)
    truth = rng.random(5000) < 0.8
    votes = np.where(rng.random((5000, 8)) < 0.2, 2, np.where(rng.random((5000, 8)) < np.linspace(0.6, 0.95, 8), truth[:, None], ~truth[:, None]))
    patterns = (votes * 3 ** np.arange(7, -1, -1)).sum(axis=1)
    k, n = np.unique(patterns, return_counts=True)
    m = weak_quality.expectation_maximisation(k, n.astype(float))
    assert abs(m.prior - 0.8) < 0.03 and np.mean((m.posterior(patterns) > 0.5) == truth) > 0.96
    assert np.abs(np.array(list(m.accuracies().values())) - np.linspace(0.6, 0.95, 8)).max() < 0.06


def test_quality_held_out(spark):
    import duckdb

    df = duckdb.sql("SELECT d.doc_id, text, quality FROM '/root/testdata/sf0.01/documents.parquet' d JOIN '/root/testdata/sf0.01/labels.parquet' l USING (doc_id)").df()
    got = {r.doc_id: r.kept for r in registry.QUERIES["op8_weak_quality"](spark, "/root/testdata/sf0.01").select("doc_id", "kept").collect()}
    kept = df.doc_id.map(got)
    assert kept[df.quality == 1].mean() > 0.97 and kept[df.quality == 0].mean() < 0.2


def toxic_rows(n):
    rng = random.Random(4)
    words, slurs = [f"w{i}" for i in range(300)], ["grumplo", "grumpla", "vexit"]
    out = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        if i % 4 == 0:
            t[rng.randrange(len(t))] = rng.choice(slurs) + rng.choice(["", "n", "ner", "!"])
        out.append((" ".join(t), int(i % 4 == 0)))
    return out


def test_toxicity_learns_stems():
    rows = toxic_rows(1200)
    texts, y = [t for t, _ in rows], np.array([c for _, c in rows], float)
    model, limits = toxicity.train(texts[:900], y[:900], ["en"] * 900)
    ids, ends, feats = toxicity._flat([toxicity.words_of(t) for t in texts[900:]])
    score = model.score(model.pooled(ids, ends, model.taps(feats)))
    assert ((score >= 0.7) == (y[900:] == 1)).mean() > 0.97 and 0 < limits["en"] < 1


def test_toxicity_query(spark, folder):
    got = registry.QUERIES["op9_toxicity"](spark, folder).collect()
    assert len(got) == len(rows_of(folder)) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[20] == by[60] == by[61]
    assert toxicity.train(["a", "b"], np.zeros(2), [None, None]) == (None, {})


def brute_score(model, text):
    """A text's score from the definition: each window of each width, one by one."""
    x = [model.embed[toxicity.features(w)].sum(axis=0) for w in toxicity.words_of(text)]
    h = []
    for conv, bias, w in zip(model.conv, model.bias, toxicity.WIDTHS, strict=True):
        r = [sum(x[i + j] @ conv[j] for j in range(w)) + bias for i in range(len(x) - w + 1)]
        h.append(np.maximum(np.max(r, axis=0), 0) if r else np.zeros(toxicity.FILTERS))
    return float(model.score_of(np.array(np.concatenate(h) @ model.out + model.b)))


def test_toxicity_scores_by_definition(monkeypatch):
    model = toxicity.Model(3)
    data = ["", "a", "one two", *texts()[:6], "x" * 300, "  ".join(f"w{i}" for i in range(90)), "é ß\nñ"]
    expected = [brute_score(model, t) for t in data]
    for size in (1 << 20, 64, 7):
        monkeypatch.setattr(toxicity, "SLICE", size)
        monkeypatch.setattr(toxicity, "pieces_of", lambda t, f=toxicity.pieces_of, n=size: f(t, n))
        assert np.allclose(toxicity.Scorer(model).scores([t.encode() for t in data]), expected, atol=1e-5)
        monkeypatch.undo()
    assert all(b"".join(toxicity.pieces_of(t.encode(), 10)) == t.encode() for t in data)


def test_url_rules(spark, folder):
    got = {r.page_id: r for r in registry.QUERIES["op10_url_markov"](spark, folder).collect()}
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert set(got) == set(urls)
    by_url = {urls[i]: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()}
    assert by_url["https://WWW.b.example.net/en/0.html?x#y"] == ("www.b.example.net", "/en/0.html", "example.net/en/", "allow")
    assert by_url["https://a.example.net/de/0.html?x#y"][2:] == ("net/", "block") and by_url["https://a.example.org/fr/0.html?x#y"][2:] == ("org/fr/", "allow")
    assert by_url[None][:3] == by_url["no-scheme"][:3] == ("", "", None)
    assert by_url["http://net"][:3] == ("net", "", None) and by_url["http://NET/"][2] == "net/" and by_url["http://É.net/x"][0] == "É.net"
    assert by_url["a://b://c/d"][:2] == ("b:", "//c/d") and by_url["http://x.org/fr"][2] is None and by_url["http://xexample.net/en/"][2] == "net/"


def test_gram_weights_are_distributions(spark):
    """Over all characters after a context, each model's probabilities sum to one."""
    chars = "abcdefghijklmnopqrstuvwxyz0./_-~^$"
    assert len(chars) == url_filter.ALPHABET
    counts = spark.createDataFrame([("aab" + c, i % 5, (i * 7) % 3) for i, c in enumerate(chars)], "gram string, a long, r long")
    w = {r.gram: r.ratio for r in url_filter.gram_weights(counts).collect()}
    assert len(w) == len(chars) and min(w.values()) < 0 < max(w.values())


def test_sql(spark, folder, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet' QUALIFY row_number() OVER (PARTITION BY doc_id) = 1")
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    docs = spark.read.parquet(f"{folder}/documents.parquet").dropDuplicates(["doc_id"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/pages.parquet").write.parquet(f"{tmp_path}/pages.parquet")
    for name, sql in registry.SQL.items():
        got = registry.QUERIES[name](spark, str(tmp_path))
        expected = con.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, expected)), name


def test_stages_keep_columns_and_clean_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
    assert line_dedup.stage(spark, docs, folder).count() == docs.count()
    kept = simhash_dedup.stage(spark, docs, folder)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in registry.QUERIES["op6_simhash"](spark, folder).collect()})


def test_pipeline_against_its_parts(spark, folder):
    """run() equals the stages one by one, each from brute-force counts of the one before."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = common.cut(stage(spark, docs, folder), "test")
    mixed = common.cut(corpus_pipeline.STAGES[3][1](spark, docs, folder), "test")
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r.doc_id for r in mixed.collect())
    prints = np.array([simhash_dedup.fingerprint((r.text or "").encode()) for r in docs.collect()], np.uint64)
    assert len(set(reachable(prints).tolist())) == len(prints)


def test_empty_pipeline(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
