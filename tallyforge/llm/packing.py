"""Documents packed into sequences of a fixed number of tokens by a grouping genetic algorithm.

A document is its token ids and one closing id. Only documents longer than a
sequence are cut, into whole sequences and a rest. Pieces are dealt by a hash
of their row into shards of about ``shard`` pieces. A chromosome is a shard's
packing and its genes are bins. The first island begins with best fits of the
pieces in falling order of length, exact and with noise, the others with best
fits in random orders, which leave more to recombine. Crossover takes whole well-filled bins from one parent, throws
out the other's bins that hold any of the same pieces, and best-fits what these
displaced; mutation empties the worst bins and some others and best-fits their
pieces again. Fitness is the number of bins and then the sum of their squared
fills, so that what is free comes together in few bins. Every shard is evolved on
several islands, each a row of its own, so islands run anywhere; after each epoch
an island's best packing migrates to the next island of the ring. An island ends
before its generations do only with a packing that is proved the best there is:
as few bins as the sum of lengths asks for, all but one of them full.

Bins that the winner fills to the last place are final. The pieces of the others
are dealt into new shards and evolved once more, so that the rooms of each shard
are offered to the pieces of others; the second time all bins are final.

Defined results: a null or empty text is one piece that holds the closing id;
rows that repeat an id, or have none, are pieces of their own; a very long text is
cut into as many pieces as it fills;
columns other than the two that are named are not read; an empty table gives an
empty table. Packings depend on the rows' order of arrival only among equal rows.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, parts, released, table, tasks

CAPACITY, CLOSING, VOCABULARY = 4096, 1, "word_bpe_49k.json"
SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4096, 3, 2, 5, 4
#: Of a parent's bins, those that may be injected and those of them that are; of all bins, those that mutation empties as worst, and as many others.
WELL_FILLED, INJECTED, EMPTIED = 0.8, 0.6, 0.1
#: Words whose ids a worker remembers, twice over: those met lately and those met before; and pretokens.
REMEMBERED = 1 << 18

#: Text whose pretokens one pattern finds: printable Latin-1 and plain white space.
PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])

#: The vocabulary's own split on such text in lower case: contractions, letters, single digits, other signs.
LETTERS, DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")


@functools.cache
def _shown() -> dict[int, str]:
    """The sign by which a byte-level vocabulary shows each byte: itself if printable, else the next one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Pretokens(dict):
    """Token ids, as little-endian 32-bit bytes, of single pretokens."""

    def __init__(self, model):
        self.tokenize = model.tokenize

    def __missing__(self, part: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(_shown())
        self[part] = ids = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(shown)])
        return ids


class Words(dict):
    """Token ids of words without white space, which don't depend on a word's neighbours. Words of the last two fillings stay known."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.before = Tokenizer.from_file(path), {}
        self.pretokens = Pretokens(self.tokenizer.model)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(word)
        self[word] = ids = b"".join(map(self.pretokens.__getitem__, PRETOKEN.findall(word))) if ids is None else ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.before.clear()
        self.pretokens.clear()

    def text(self, text: str) -> bytes:
        """Ids of a whole text. One with other characters, or a special token's name, goes to the tokenizer as it is."""
        b = text.encode("latin-1", "ignore")
        if len(b) == len(text) and not b.translate(None, PLAIN) and "<|" not in text:
            return b"".join(map(self.__getitem__, text.lower().split()))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_words: dict[str, Words] = {}


def _words_of(path: str) -> Words:
    """One per worker process, which serves many tasks."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def _pieces(vocabulary: str, capacity: int, closing: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        words, end = _words_of(public_tokenizers.path(vocabulary)), np.array([closing], "<u4").tobytes()
        for batch in parts(batches):
            doc, piece, start, length, crc = [], [], [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.text(t or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    doc.append(d)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, batch.column(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        # The worker may go on to other work and would hold two hundred megabytes; the vocabulary stays.
        words.forget()
        released()

    return run


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, closing: int = CLOSING) -> DataFrame:
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(vocabulary, capacity, closing), schema)


# A packing is a list of bins, each a list of positions in the shard's lengths.


class _Rooms:
    """Bins by free room; the smallest room that takes a piece is found in one step of a bit mask."""

    def __init__(self):
        self.mask, self.by = 0, {}

    def put(self, b: list[int], room: int) -> None:
        self.by.setdefault(room, []).append(b)
        self.mask |= 1 << room

    def take(self, need: int) -> tuple[list[int] | None, int]:
        m = self.mask >> need
        if not m:
            return None, 0
        room = need + (m & -m).bit_length() - 1
        b = self.by[room].pop()
        if not self.by[room]:
            self.mask &= ~(1 << room)
        return b, room


def _fill(b: list[int], lengths: list[int]) -> int:
    return sum(map(lengths.__getitem__, b))


def best_fit(bins: list[list[int]], items: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    """bins with items added in their order, each to the bin that it leaves the least room in."""
    rooms = _Rooms()
    for b in bins:
        rooms.put(b, capacity - _fill(b, lengths))
    for i in items:
        b, room = rooms.take(lengths[i])
        if b is None:
            b, room = [], capacity
            bins.append(b)
        b.append(i)
        rooms.put(b, room - lengths[i])
    return bins


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), sum((_fill(b, lengths) / capacity) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """b with some of a's well-filled bins in place of every bin that shares a piece with them."""
    fullest = sorted(a, key=lambda x: -_fill(x, lengths))[: max(1, int(len(a) * WELL_FILLED))]
    injected = rng.sample(fullest, max(1, int(len(fullest) * INJECTED)))
    held = {i for x in injected for i in x}
    kept, displaced = [list(x) for x in injected], []
    for x in b:
        if held.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in held]
    return best_fit(kept, sorted(displaced, key=lambda i: -lengths[i]), lengths, capacity)


def mutate(bins: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """The emptiest bins and as many others are emptied and their pieces best-fitted again."""
    order = sorted(bins, key=lambda x: _fill(x, lengths))
    n = max(2, int(len(order) * EMPTIED))
    out = order[:n] + rng.sample(order[n:], min(n, len(order) - n)) if len(order) > n else order
    gone = {id(x) for x in out}
    items = [i for x in out for i in x]
    rng.shuffle(items)
    return best_fit([list(x) for x in bins if id(x) not in gone], sorted(items, key=lambda i: -lengths[i]), lengths, capacity)


def _start(lengths: list[int], capacity: int, n: int, rng: random.Random, falling: bool = False) -> list[list[list[int]]]:
    """Best fits in random orders, or in orders of falling length with more and more noise."""
    everyone, out = list(range(len(lengths))), []
    for k in range(n):
        rng.shuffle(everyone)
        out.append(best_fit([], sorted(everyone, key=lambda i: -lengths[i] * (1 + 0.1 * k * rng.random())) if falling else everyone, lengths, capacity))
    return out


def best_possible(lengths: list[int], capacity: int) -> tuple[int, float]:
    """The fitness of full bins and one for the rest, which no packing exceeds."""
    full, rest = divmod(sum(lengths), capacity)
    return -(full + (rest > 0)), full + (rest / capacity) ** 2


def evolve(people: list[list[list[int]]], lengths: list[int], capacity: int, generations: int, rng: random.Random) -> tuple[list[list[list[int]]], int, int]:
    """The population after some generations, best first; how many crossovers there were and how many gave a new best."""
    goal, gains = best_possible(lengths, capacity), 0
    ranked = sorted(((fitness(x, lengths, capacity), x) for x in people), key=lambda x: x[0], reverse=True)
    for done in range(generations):
        best = ranked[0][0]
        if best[0] == goal[0] and best[1] >= goal[1] - 1e-9:
            return [x for _, x in ranked], done, gains
        (_, a), (_, b) = rng.sample(ranked, 2) if len(ranked) > 1 else (ranked[0], ranked[0])
        child = mutate(crossover(a, b, lengths, capacity, rng), lengths, capacity, rng)
        own = fitness(child, lengths, capacity)
        gains += own > best
        if all(own != x for x, _ in ranked):  # a packing that is there already adds nothing
            ranked = sorted([*ranked, (own, child)], key=lambda x: x[0], reverse=True)[: len(ranked)]
    return [x for _, x in ranked], generations, gains


def _genes(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(genes: np.ndarray) -> list[list[int]]:
    order = np.argsort(genes, kind="stable")
    cuts = np.flatnonzero(np.diff(genes[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)] if len(genes) else []


ISLAND = "shard long, island int, rows array<long>, lengths array<int>, people array<array<int>>, crossovers int, gains int"


def _epoch(epoch: int, capacity: int, generations: int, population: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for shard, island, rows, lengths, people, crossovers, gains in f.itertuples(index=False):
                sizes, rng = lengths.tolist(), random.Random(f"{shard}/{island}/{epoch}")
                now = [_bins(np.asarray(x)) for x in people] if people is not None and len(people) else _start(sizes, capacity, population, rng, island == 0)
                now, done, better = evolve(now, sizes, capacity, generations, rng)
                out.append((shard, island, rows, lengths, [_genes(x, len(sizes)) for x in now[:population]], crossovers + done, gains + better))
            yield pd.DataFrame(out, columns=["shard", "island", "rows", "lengths", "people", "crossovers", "gains"])

    return run


def _decode(capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard, rows, lengths, best in zip(f["shard"], f["rows"], f["lengths"], f["best"], strict=True):
                order = np.argsort(best, kind="stable")
                bins, size = best[order], lengths[order].astype(np.int64)
                first = np.r_[True, bins[1:] != bins[:-1]]
                before = np.cumsum(size) - size
                offset = before - np.maximum.accumulate(np.where(first, before, 0))
                done = np.bincount(bins, weights=size)[bins] >= capacity
                yield pd.DataFrame({"shard": shard, "row": rows[order], "bin": bins, "offset": offset, "length": size, "done": done})

    return run


def islands_of(items: DataFrame, capacity: int, shard: int, islands: int) -> DataFrame:
    """The evolved islands of items(row, length): a row each, with its population, best first, and its counts of crossovers and gains."""
    spark = items.sparkSession
    n = max(1, -(-items.count() // shard))
    n_tasks = max(tasks(spark), min(n * islands, 20_000))
    shards = items.groupBy(F.pmod(F.xxhash64("row"), F.lit(n)).alias("shard")).agg(F.array_sort(F.collect_list(F.struct("row", F.col("length").cast("int").alias("length")))).alias("all"))
    none = F.lit(0).alias
    state = shards.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("all.row").alias("rows"), F.col("all.length").alias("lengths"), F.lit(None).cast("array<array<int>>").alias("people"), none("crossovers"), none("gains")
    )
    for epoch in range(EPOCHS):
        if epoch:
            elite = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("people")[0].alias("elite"))
            state = state.join(elite, ["shard", "island"]).select("shard", "island", "rows", "lengths", F.concat(F.array("elite"), F.slice("people", 1, POPULATION - 1)).alias("people"), "crossovers", "gains")
        state = cut(state.repartition(n_tasks, "shard", "island").mapInPandas(_epoch(epoch, capacity, GENERATIONS, POPULATION), ISLAND), "islands")
    return state


def _pack(items: DataFrame, capacity: int, shard: int, islands: int) -> DataFrame:
    """(shard, row, bin, offset, length, done) of items(row, length); done: in a full bin."""
    state = islands_of(items, capacity, shard, islands)
    best = F.col("people")[0]
    # The winner of a shard's islands: fewest bins, ties to the first island.
    won = state.groupBy("shard").agg(F.min_by(F.struct("rows", "lengths", best.alias("best")), F.struct(F.array_max(best), "island")).alias("w")).select("shard", "w.*")
    n = tasks(items.sparkSession)
    return won.repartition(n, "shard").mapInPandas(_decode(capacity), "shard long, row long, bin int, offset long, length long, done boolean")


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS) -> DataFrame:
    """(row, sequence_id, offset) of items(row, length)."""
    first = cut(_pack(items, capacity, shard, islands), "packed")
    second = _pack(cut(first.where("NOT done").select("row", "length"), "left"), capacity, shard, islands)
    name = lambda level: (F.col("shard") * F.lit(2 * (shard * 8)) + F.col("bin") * 2 + level).alias("sequence_id")
    return first.where("done").select("row", name(0), "offset").union(second.select("row", name(1), "offset"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """A row for each piece of each document, with its sequence and its place there."""
    # The id of a row is settled by writing it: reruns of lost tasks read what was written.
    found = cut(pieces(docs).withColumn("row", F.monotonically_increasing_id()), "pieces")
    places = pack(found.select("row", "length"))
    return found.join(places, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: pieces and their sequences."""
    return pack_documents(docs)
