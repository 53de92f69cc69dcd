"""The pipeline's near-dedup: of each group of near copies one document stays.

Two texts are near copies if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more. Texts with equal sets are one class from the start.

Candidates come from two indexes. The first is op6's: SimHash fingerprints, here of
the five-word sets, found within two bits of each other by multi-index hashing;
each class asks the first one of its fingerprints' component. At 0.8 fingerprints
differ in about ten of 64 bits, and an index that wide asks for most of the
corpus, so what op6 leaves comes from MinHash: 48 bands of 8 minima each, so a pair
at similarity 0.8 shares a band with probability 1 - (1 - 0.8^8)^48 = 0.9998, and
more above; texts that have half of their words in common share one with
probability 0.001 or less, so a passage in many documents hardly brings them
together.

In a band the members' sketches, a byte each of 128 minima, are compared before
any set travels: pairs that agree in fewer than ``LEAST_EQUAL`` of them are not at
0.8 (five standard deviations). A band of more than ``block`` members is dealt in
blocks, each pair of which is a group of its own, so every pair of members meets
at any size, and none is left to a cut. What is left is verified by the exact
similarity of both sets, in two passes: first each member's ``NEAREST`` most
similar ones, which join most groups of copies; then all pairs that are not in one
component by then. Links inside a component tell nothing new, so components are
those of all links, whatever the size of a band.

Comparing sketches costs the square of a band of texts that are neither near
copies nor apart in any of 8 minima; it is done in numpy, block by block, and moves
a member once for each block.

Defined results: classes are ordered by their smallest document id (null last)
and row; each component keeps the one row that comes first, whatever ids are
null or repeated; texts without a word are one class; fewer than five words are
one shingle; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, bitmap, cut, heaviest, links_to_components, marked, parts, raw, settled
from .simhash_dedup import components, majority

SEED, WORDS, BANDS, PER_BAND, BLOCK = 42, 5, 48, 8, 1024
#: Minima in a sketch, how many of them are equal at least in a candidate, and candidates of each member in the first pass.
SKETCH, LEAST_EQUAL, NEAREST = 128, 79, 2
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 64, BANDS * PER_BAND, np.uint64)
_ODD = _RNG.integers(0, 1 << 64, BANDS * PER_BAND, np.uint64) | np.uint64(1)


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    words = text.lower().split()
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-n])).tolist()
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)], np.uint64))


def minima(h: np.ndarray) -> np.ndarray:
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):
        least = np.minimum(least, ((h[i : i + 1024, None] ^ _XOR) * _ODD).min(axis=0))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, PER_BAND))], np.uint64)


def sketch(least: np.ndarray) -> bytes:
    """A byte of each minimum, mixed, as the least of many values begin with zeros."""
    return ((least[:SKETCH] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        known: dict[bytes, tuple[bytes, np.ndarray, bytes, int]] = {}
        for text in batch.column(1).to_pylist():
            if text not in known:
                h = shingles(text)
                least = minima(h)
                known[text] = (xxhash.xxh3_128_digest(h.tobytes()), bands(least).view(np.int64), sketch(least), majority(h))
        out = [known[t] for t in batch.column(1).to_pylist()]
        flat = pa.array(np.concatenate([b for _, b, _, _ in out]) if out else np.empty(0, np.int64))
        prints = pa.array(np.array([p for *_, p in out], np.uint64).view(np.int64))
        offsets = pa.array(np.arange(0, BANDS * len(out) + 1, BANDS, np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, *_ in out], pa.binary()), pa.ListArray.from_arrays(offsets, flat), pa.array([s for _, _, s, _ in out], pa.binary()), prints], ["row", "key", "bands", "sketch", "print"])


def _sets(words: np.ndarray):
    """(row, set) of those of (row, h, text) whose h may be among a bitmap's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 256):
            batch = batch.filter(pa.array(marked(words, batch.column(1).to_numpy())))
            out = [shingles(t).view(np.int64) for t in batch.column(2).to_pylist()]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out) if out else np.empty(0, np.int64)))], ["row", "set"])

    return run


def verified(pairs: DataFrame, texts: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Those of pairs(a, b) that are near copies; texts: (node, row) and (row, text)."""
    nodes, rows = texts
    asked = cut(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), "asked")
    # Texts stay where they are, and only sets that are asked for travel; the bitmap lets a few through for nothing.
    h = F.xxhash64("row").alias("h")
    made = rows.select("row", h, raw("text")).mapInArrow(_sets(bitmap(asked.select(h))), "row long, set array<long>")
    sets = cut(made.join(asked, "row").select("node", "set"), "sets")
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both, common = F.size("x") + F.size("y"), F.size(F.array_intersect("x", "y"))
    # common / (both - common) >= 4 / 5
    return pairs.join(a, "a").join(b, "b").where(9 * F.least(F.size("x"), F.size("y")) >= 4 * both).where(9 * common >= 4 * both).select("a", "b")


def candidates(nodes: np.ndarray, side: np.ndarray, sketches: np.ndarray, roots: np.ndarray | None, nearest: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group that may be near copies: each member's nearest, or, where roots are known, all of different roots.

    side: 0 for members of the group's first block and 1 for those of its second, which meet the first only; one block meets itself.
    """
    first = np.flatnonzero(side == 0)
    second = np.flatnonzero(side == 1)
    other = second if len(second) else first
    i, j = [], []

    def meet(x: np.ndarray, y: np.ndarray) -> None:
        equal = _equal(sketches[x], sketches[y])
        k, m = np.nonzero((equal >= LEAST_EQUAL) & (roots[x][:, None] != roots[y][None, :]))
        i.append(x[k])
        j.append(y[m])

    if roots is not None:
        # Members of the commonest root have nothing to ask of each other.
        values, counts = np.unique(roots, return_counts=True)
        most = values[counts.argmax()]
        meet(first[roots[first] != most], other)
        if other is not first:
            meet(first[roots[first] == most], other[roots[other] != most])
    else:
        equal = _equal(sketches[first], sketches[other])
        if other is first:
            np.fill_diagonal(equal, -1)
        # A block's members ask the first block; its members ask each other, as all do in their own block.
        way = equal.T
        k = min(nearest, way.shape[1])
        top = np.argpartition(-way, k - 1, axis=1)[:, :k] if k < way.shape[1] else np.broadcast_to(np.arange(k), (way.shape[0], k))
        at, to = np.repeat(np.arange(len(way)), k), top.ravel()
        kept = way[at, to] >= LEAST_EQUAL
        i.append(other[at[kept]])
        j.append(first[to[kept]])
    a, b = nodes[np.concatenate(i)], nodes[np.concatenate(j)]
    return np.minimum(a, b), np.maximum(a, b)


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes of each of a's sketches are those of each of b's."""
    if len(a) * len(b) <= 4096:
        return (a[:, None, :] == b[None, :, :]).sum(axis=2, dtype=np.int16)
    equal = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        equal += a[:, k, None] == b[None, :, k]
    return equal.astype(np.int16)


def _pairs(rooted: bool):
    """Candidates of groups, whose rows come together: band, i, j, side, node, sketch, and root in the second pass."""

    def of_group(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        columns = list(zip(*rows, strict=True))
        sketches = np.frombuffer(b"".join(columns[5]), np.uint8).reshape(len(rows), -1)
        return candidates(np.array(columns[4], np.int64), np.array(columns[3]), sketches, np.array(columns[6], np.int64) if rooted else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, out, n = [], [], 0
        for batch in parts(batches, 4096):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    if len(group) > 1:
                        out.append(of_group(group))
                        n += len(out[-1][0])
                    group = []
                group.append(row)
                if n > 65536:
                    yield distinct(out)
                    out, n = [], 0
        if len(group) > 1:
            out.append(of_group(group))
        if out:
            yield distinct(out)

    def distinct(found: list[tuple]) -> pa.RecordBatch:
        both = np.unique(np.stack([np.concatenate([f[k] for f in found]) for k in (0, 1)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return run


def _met(members: DataFrame, block: int) -> DataFrame:
    """Candidate pairs (a, b) of members(band, node, sketch) or members(band, node, sketch, root), in groups of two blocks at most.

    Without roots a large band's blocks meet themselves and the first of them. With
    roots, members of the band's commonest root have nothing to ask of each other:
    the others, where they are few, go to each of its blocks; where they are many,
    every block meets every other.
    """
    rooted = "root" in members.columns
    if rooted:
        counts = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("band").agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.max_by("root", F.struct("k", "root")).alias("major"))
        # A band all of whose members are in one component has no news.
        counts = counts.where("n > most")
    else:
        counts = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = cut(counts, "band_sizes")
    least = heaviest(counts)
    often, seldom = F.broadcast(counts.where(F.col("n") >= least)), counts.where(F.col("n") < least)
    # Members are bands of a class each, which Spark takes for as small as the classes.
    met = members.join(often, "band").unionByName(members.join(often.select("band"), "band", "left_anti").hint("merge").join(seldom, "band"))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    to = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), blocks(n) - 1), f)
    zero, one, lone = F.lit(0), F.lit(1), F.lit(-1)
    if rooted:
        few = F.when(F.col("root") == F.col("major"), F.array(to(own("most"), own("most"), one))).otherwise(F.concat(F.array(to(lone, lone, zero)), each("most", lambda k: to(k, k, zero))))
        every = each("n", lambda k: to(F.least(own("n"), k), F.greatest(own("n"), k), (own("n") > k)))
        place = F.when(F.col("n") <= block, F.array(to(zero, zero, zero))).when(F.col("n") - F.col("most") <= block, few).otherwise(every)
    else:
        place = F.when(own("n") == 0, each("n", lambda k: to(zero, k, zero))).otherwise(F.array(to(zero, own("n"), one), to(own("n"), own("n"), zero)))
    group = met.select("band", F.explode(place).alias("to"), "node", "sketch", *(["root"] if rooted else [])).select("band", "to.*", "node", "sketch", *(["root"] if rooted else []))
    keys = ["band", "i", "j"]
    dealt = group.repartition(*keys).sortWithinPartitions(*keys)
    return cut(dealt.mapInArrow(_pairs(rooted), "a long, b long").distinct(), "pairs")


def simhash_pairs(classes: DataFrame) -> DataFrame:
    """(a, b), a < b: each of classes(node, print) with the first one of its component among op6's fingerprints."""
    prints = classes.select(F.col("node").alias("doc_id"), "print")
    return prints.join(components(prints), "print").where("component_id < doc_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))


def near_links(members: DataFrame, texts: tuple[DataFrame, DataFrame], near: DataFrame, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b), a < b, of members(node, band, sketch) and of pairs near(a, b), whose components are those of all links."""
    first = cut(verified(cut(near.union(_met(members, block)).distinct(), "near"), texts), "links")
    roots = links_to_components(first)
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return first.union(cut(verified(_met(rooted, block), texts), "links"))


def heads(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row) of the one row of each component that stays, of rows(row, doc_id, text)."""
    made = cut(rows.select("row", raw("text")).mapInArrow(_signatures, "row long, key binary, bands array<long>, sketch binary, print long"), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = made.join(rows.select("row", "doc_id"), "row").groupBy("key").agg(F.min(first).alias("f"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("print").alias("print"))
    # Sorted and then numbered, so that nodes stand in the order of (doc_id, row).
    classes = cut(classes.select("f.*", "bands", "sketch", "print").orderBy("none", "doc_id", "row").withColumn("node", F.monotonically_increasing_id()).select("node", "row", "bands", "sketch", "print"), "classes")
    near = cut(simhash_pairs(classes), "simhash_pairs")
    held = classes.select("node", F.explode("bands").alias("band"), "sketch")
    # What shares no band with another goes before its sketch travels; the bitmap lets a few through for nothing.
    shared = among(bitmap(classes.select(F.explode("bands").alias("h")).groupBy("h").count().where("count > 1")))
    links = near_links(held.where(shared("band")), (classes.select("node", "row"), rows), near, block)
    gone = links_to_components(links).select("node")
    return classes.join(gone, "node", "left_anti").select("row")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the smallest (doc_id, row) stays."""
    # The key of a row is settled by writing it: reruns of lost tasks read what was written.
    rows = cut(docs.select(F.struct("*").alias("own")).withColumn("row", F.monotonically_increasing_id()), "rows")
    kept = settled(lambda: heads(rows.select("row", "own.doc_id", "own.text")), "heads")
    return rows.join(kept, "row", "left_semi").select("own.*")
