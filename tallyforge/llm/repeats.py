"""Passages that stand elsewhere too are taken out, byte by byte.

A byte goes if it lies in a string of ``length`` bytes that starts at another
place as well, in the same document or any other. Strings are judged on the
input; matches don't cross documents.

1. Equal texts are one class by their SHA-256. All bytes of a class of two rows
   and at least ``length`` bytes go; one text of each class is searched.
2. Every string of ``length`` bytes picks an anchor from its own bytes: of the
   ``GRAM``-byte grams in it, those of the least hash. Equal strings pick equal
   grams at equal places, so only grams that occur twice can belong to repeats.
   Their hashes are counted by partial sums; a bitmap of fixed size says which
   grams may be repeated, and those send themselves with the bytes around them
   that such strings can reach: a segment. What the bitmap lets through for
   nothing costs a row and finds nothing. Of equal segments in a text, as a word
   that repeats for pages has them, all are repeats and one is sent.
3. Segments with the same gram are put below each other, gram under gram, and a
   collection of whole groups is read column by column from the right. Each
   round inserts one symbol of every segment: the order of the suffixes that
   begin in this column follows from the one of the column before by a stable
   sort of the new symbols (the step from last to first column of a
   Burrows-Wheeler transform), and their common prefixes are one more than the
   least between two equal symbols in the old order. Equal strings stand in the
   same column, as their grams do, so suffixes of other columns need not be in
   the collection, and a round costs what it inserts. A prefix of ``length``
   shared with a neighbour is a repeat. Rounds stream over arrays of a bounded
   collection, and collections stream from sorted shuffle files.
4. Groups of more than ``most`` segments are halved instead: a range of places
   relative to the gram has bytes that all strings at those places share. Ranges
   whose shared bytes occur once drop out, others are split until a range is one
   string. Each level is a count by partial sums, whatever the size of a group.
5. Rows whose class has spans are joined with them; all others are left as they
   are without a shuffle.

Defined results: null and empty texts have no bytes; texts of fewer than
``length`` bytes are kept; equal rows count as two places, whatever their ids, so
both lose everything; null ids are ids like any other; very long texts are
searched in windows of ``STEP`` bytes, and held whole by the task of their row;
an edge of a span may cut a character, as bytes are judged; other columns are kept
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT, among, bitmap, cut, discard, heaviest, marked, parts, raw, table, tasks

LENGTH, GRAM, STEP = 200, 64, 1 << 20
#: Segments of a collection, and of the largest group that is sorted in one.
BLOCK, MOST = 1 << 14, 1 << 15
_P = 0x9E3779B97F4A7C15
_SEGMENT = "gram long, key binary, at int, first int, bytes binary"
_SPAN = "key binary, start int, end int"
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


class Grams:
    """Hashes of all grams of a text, by prefix sums of a polynomial modulo 2^64, and the anchors among them."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        n = STEP + length + 1
        self.power, self.back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64)))) for x in (_P, pow(_P, -1, 1 << 64)))

    def hashes(self, data: np.ndarray) -> np.ndarray:
        g = self.gram
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=sums[1:])
        h = (sums[g:] - sums[:-g]) * self.back[: len(data) - g + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h

    def anchors(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of grams that some string of ``length`` bytes picks; of equal least ones all."""
        whole = np.frombuffer(text, np.uint8)
        places, values = [], []
        for start in range(0, max(len(whole) - self.length + 1, 0), STEP):
            h = self.hashes(whole[start : start + STEP + self.length - 1])
            least, covered, rest, size, run = None, 0, self.width, 1, h
            n = len(h) - self.width + 1
            while rest:
                if rest & 1:
                    piece = run[covered : covered + n]
                    least = piece if least is None else np.minimum(least, piece)
                    covered += size
                rest >>= 1
                if rest:
                    run, size = np.minimum(run[:-size], run[size:]), 2 * size
            # A gram is picked if it is the least of a string, and the least of strings over it can only be smaller elsewhere.
            picked = np.unique(least)
            at = np.flatnonzero(h == picked[np.minimum(np.searchsorted(picked, h), len(picked) - 1)])
            places.append(at + start)
            values.append(h[at])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, first = np.unique(np.concatenate(places), return_index=True)
        # Least hashes begin with zeros; a product spreads them over all values again.
        return at, (np.concatenate(values)[first] * np.uint64(_P)).view(np.int64)


def _counted(grams: Grams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 256):
            found = [grams.anchors(t)[1] for t in batch.column(0).to_pylist()]
            if found and len(all_ := np.concatenate(found)):
                h, n = np.unique(all_, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    return run


def _segments(grams: Grams, words: np.ndarray):
    """Segments of a text's grams that may be repeated. Of equal ones in a text one is sent; as they are repeats, spans of all are rows without bytes."""
    reach = grams.length - grams.gram

    def of_text(text: bytes) -> tuple[list[tuple], list[tuple[int, int]]]:
        at, h = grams.anchors(text)
        hit = marked(words, h)
        sent: dict[bytes, list] = {}
        spans: list[tuple[int, int]] = []
        for p, g in zip(at[hit].tolist(), h[hit].tolist(), strict=True):
            first = max(p - reach, 0)
            own = text[first : p + grams.gram + reach]
            if (seen := sent.setdefault(xxhash.xxh3_128_digest(own, p - first), [p, g, first, len(own)]))[0] == p:
                continue
            for s, e in ((seen[2], seen[2] + seen[3]), (first, first + len(own))) if seen[3] >= grams.length else ():
                if spans and spans[-1][0] <= s <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
                else:
                    spans.append((s, e))
        return [(g, p, first, text[first : first + n]) for p, g, first, n in sent.values()], spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 256):
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, spans = of_text(text)
                out += [(g, key, *rest) for g, *rest in found]
                out += [(0, key, s, e, None) for s, e in set(spans)]
            for i in range(0, len(out), 4096):
                columns = zip(*out[i : i + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["gram", "key", "at", "first", "bytes"])

    return run


def columns_repeated(segments: list[bytes], shift: list[int], length: int) -> np.ndarray:
    """repeated[c, i]: the string of ``length`` bytes that begins in column c of segment i has an equal in column c of another.

    Segment i begins in column shift[i]. One round a column, from the last to the first.
    """
    m, width = len(segments), max(s + len(b) for s, b in zip(shift, segments, strict=True))
    symbols = np.full((width, m), 256, np.uint16)  # 256: no byte, equal to nothing
    for i, (s, b) in enumerate(zip(shift, segments, strict=True)):
        symbols[s : s + len(b), i] = np.frombuffer(b, np.uint8)
    repeated = np.zeros((max(width - length + 1, 0), m), bool)
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    for c in range(width - 1, -1, -1):
        new = symbols[c][order]
        at = np.argsort(new, kind="stable")
        sorted_ = new[at]
        same = np.flatnonzero((sorted_[1:] == sorted_[:-1]) & (sorted_[1:] != 256)) + 1
        longer = np.zeros(m + 1, np.int32)
        if len(same):
            # Pairs of ends from the last to the first: what lies between two of them is then never reduced.
            ends = np.empty((len(same), 2), np.int64)
            ends[:, 0], ends[:, 1] = at[same - 1] + 1, at[same] + 1
            longer[same] = 1 + np.minimum.reduceat(common, ends[::-1].ravel())[::2][::-1]
        order, common = order[at], longer
        if c < len(repeated):
            far = common[:-1] >= length
            far[:-1] |= far[1:]
            repeated[c, order[far]] = True
    return repeated


def runs_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return edge[::2], edge[1::2] - 1


def _found(rows: list[tuple], reach: int, length: int) -> Iterator[pa.RecordBatch]:
    _, keys, at, first, data = zip(*rows, strict=True)
    shift = [reach - (p - f) for p, f in zip(at, first, strict=True)]
    repeated = columns_repeated(data, shift, length)
    out = []
    for i in np.flatnonzero(repeated.any(axis=0)).tolist():
        for a, b in zip(*(x.tolist() for x in runs_of(repeated[:, i])), strict=True):
            start = at[i] - reach
            out.append((keys[i], start + a, start + b + length))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.int32()), strict=True)], ["key", "start", "end"])


def _collections(reach: int, length: int, block: int):
    """Whole groups, which come sorted by gram, in collections of about ``block`` segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        for batch in parts(batches, 4096):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[0] != group[0][0]:
                    held += group if len(group) > 1 else []
                    group = []
                    if len(held) >= block:
                        yield from _found(held, reach, length)
                        held = []
                group.append(row)
        held += group if len(group) > 1 else []
        if held:
            yield from _found(held, reach, length)

    return run


def _halved(reach: int, gram: int, length: int):
    """Ranges of places lo..hi before the gram, split in two, with a hash of the bytes that all strings there share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1024):
            out = []
            for _, key, at, first, data, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b in ((lo, (lo + hi) // 2), ((lo + hi) // 2 + 1, hi)):
                    # Places that fit: the string begins at at - o >= first and ends within the segment.
                    if max(a, at - first + length - len(data)) <= min(b, at - first):
                        shared = data[at - first - a : at - first - b + length]
                        out.append((xxhash.xxh3_128_digest(shared, a), key, at, first, data, a, b))
            if out:
                kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["shared", "key", "at", "first", "bytes", "lo", "hi"])

    return run


def halved(segments: DataFrame, length: int, gram: int, hot: int = HOT) -> DataFrame:
    """Spans (key, start, end) of repeated strings in segments of any number for each gram."""
    reach = length - gram
    state = segments.select(F.lit(b"").alias("shared"), "key", "at", "first", "bytes", F.lit(0).alias("lo"), F.lit(reach).alias("hi"))
    width, out, before = reach + 1, None, []
    while out is None:
        ranges = cut(state.mapInArrow(_halved(reach, gram, length), "shared binary, key binary, at int, first int, bytes binary, lo int, hi int"), "ranges")
        counts = cut(ranges.groupBy("shared").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
        discard(*before)
        before = [ranges, counts]
        width = -(-width // 2)
        if width > 1:
            near = among(bitmap(counts.select(F.xxhash64("shared").alias("h"))))
            state = ranges.where(near(F.xxhash64("shared")))
        else:
            # One string each: frequent ones are known to every task, those that are left have few rows each.
            least = heaviest(counts, hot)
            often, seldom = F.broadcast(counts.where(F.col("n") >= least).select("shared")), counts.where(F.col("n") < least).select("shared")
            some = ranges.select("shared", "key", (F.col("at") - F.col("lo")).alias("start"), (F.col("at") - F.col("lo") + length).alias("end"), (F.col("lo") == F.col("hi")).alias("one"))
            out = some.join(often, "shared", "left_semi").union(some.join(often, "shared", "left_anti").join(seldom, "shared", "left_semi")).where("one").select("key", "start", "end")
    return out


def spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(key, found) of texts(key, text), all of them different: found are the spans of bytes to remove, start and end, which may overlap."""
    spark, grams, reach = texts.sparkSession, Grams(length, gram), length - gram
    long_ = texts.where(F.octet_length("text") >= length)
    counted = cut(long_.select("text").mapInArrow(_counted(grams), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "grams")
    found = cut(long_.select("key", "text").mapInArrow(_segments(grams, bitmap(counted)), _SEGMENT), "segments")
    own = found.where("bytes IS NULL").select("key", F.col("at").alias("start"), F.col("first").alias("end"))
    segments = found.where("bytes IS NOT NULL")
    sizes = cut(segments.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    few, many = segments, None
    if (largest or 0) > most:
        big = among(bitmap(sizes.where(F.col("n") > most).select(F.col("gram").alias("h"))))
        few, many = segments.where(~big("gram")), segments.where(big("gram"))
    dealt = few.repartition(max(tasks(spark), -(-(total or 0) // (2 * block))), "gram").sortWithinPartitions("gram")
    out = own.union(dealt.mapInArrow(_collections(reach, length, block), _SPAN))
    if many is not None:
        out = out.union(halved(many, length, gram).select("key", F.col("start").cast("int"), F.col("end").cast("int")))
    out = cut(out.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("found")), "spans")
    discard(counted, found, sizes)
    return out


def merged(found: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted((s["start"], s["end"]) for s in found):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 256):
        removed, kept = [], []
        for text, whole, found in zip(batch.column("text").to_pylist(), batch.column("whole").to_pylist(), batch.column("found").to_pylist(), strict=True):
            gone = [(0, len(text))] if whole else merged(found or [])
            ends = [0, *(e for _, e in gone)]
            removed.append([{"start": s, "end": e} for s, e in gone])
            kept.append(b"".join(text[a:b] for a, b in zip(ends, [*(s for s, _ in gone), len(text)], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(removed, kind), pa.array(kept, pa.binary())], ["own", "removed", "kept"])


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(own, removed, kept): the row as it was, as a struct, the spans of bytes that go, and the bytes that stay."""
    data = raw(f"own.`{text}`")
    rows = docs.select(F.struct("*").alias("own")).select("own", F.unhex(F.substring(F.sha2(data, 256), 1, 32)).alias("key")).withColumn("h", F.xxhash64("key"))
    classes = cut(rows.groupBy("key", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "classes")
    again = among(bitmap(classes.select("h")))
    keyed = rows.select("key", "h", data.alias("text"))
    # Of texts that come twice one is searched; their rows are a part of the table, and equal ones meet before the shuffle.
    firsts = cut(keyed.where(again("h")).groupBy("key").agg(F.first("text").alias("text")), "firsts")
    texts = keyed.where(~again("h")).select("key", "text").union(firsts)
    found = spans(texts, length, gram, most, block)
    discard(firsts)
    least = heaviest(classes)
    often = F.broadcast(classes.where(F.col("n") >= least).select("key", F.lit(True).alias("whole")))
    some = among(bitmap(classes.select("h").union(found.select(F.xxhash64("key").alias("h")))))
    none = F.array().cast(_SPANS)
    long_ = F.octet_length(data) >= length
    # Rows of no such class or span need nothing more.
    plain = rows.where(~some("h")).select("own", none.alias("removed"), data.alias("kept"))
    met = rows.where(some("h")).join(often, "key", "left")
    every = F.array(F.struct(F.lit(0).alias("start"), F.octet_length(data).alias("end"))).cast(_SPANS)
    common = met.where("whole").select("own", F.when(long_, every).otherwise(none).alias("removed"), F.when(long_, F.lit(b"")).otherwise(data).alias("kept"))
    rest = met.where(F.col("whole").isNull()).drop("whole")
    rest = rest.join(classes.where(F.col("n") < least).select("key", F.lit(True).alias("twice")), "key", "left").join(found, "key", "left")
    rest = rest.select("own", data.alias("text"), (F.coalesce("twice", F.lit(False)) & long_).alias("whole"), "found")
    schema = T.StructType([T.StructField("own", rows.schema["own"].dataType), T.StructField("removed", _SPANS), T.StructField("kept", T.BinaryType())])
    return plain.union(common).union(rest.mapInArrow(_left, schema))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("own.doc_id", (F.octet_length("kept") + gone).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
