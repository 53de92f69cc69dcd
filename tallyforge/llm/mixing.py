"""Sources mixed to target weights by a min-cost flow.

Documents are aggregated by membership pattern, the set of sources that they
belong to. Capacity flows from patterns to the quotas of their sources; a
pattern's tokens may be taken up to ``most`` times, and each further repetition
costs more than the one before, so the flow repeats where it must and least
where it can. The flow over patterns says how often a pattern is taken whole
and how many of its tokens once more. Who is taken once more is settled by a
seeded hash of the document: the documents up to the last value at which their
sizes still fit, and up to three beyond it that fill the gap best. That value is
found by two rounds of sums over 4096 ranges of the hash and a running sum over
what shares 24 leading bits, so no task holds a source.

Patterns and sources are configuration in size: more than ``limit`` patterns, about
a million, are refused with a message, none is dropped. They go to the driver, whose
flow takes some seconds for ten thousand of them, and back as broadcast rows.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; sources without words have target 0; rows are told apart by id and
text, and those that share both by where they stand, so a table without ids is
mixed like any other and reruns over the same files agree; extra columns are not
read by the query and kept by the stage; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import WORD, cut, joined_by_weight, settled, table

CYCLE, MOST, SEED, LIMIT, FILLS = (5.0, 2.0, 1.0), 3, 20240229, 1 << 20, 3
#: Up to so many patterns their rows are broadcast; more are joined by key.
KNOWN = 1 << 16
_ASKED = ("_key", "_text", "_row", "_size", "_sources")


def targets(sizes: dict[str | None, int], cycle: tuple[float, ...] = CYCLE, most: float = MOST) -> dict[str | None, float]:
    """All sizes shared by weight; no source above ``most`` times its size, its excess shared by the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    out, left, free = {}, float(sum(sizes.values())), list(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * unit > most * sizes[s]]
        for s in above or free:
            out[s] = float(most * sizes[s]) if above else weight[s] * unit
        if not above:
            break
        left -= sum(out[s] for s in above)
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(capacity: dict, quota: dict[str | None, float], most: int = MOST) -> dict:
    """Tokens to take of each pattern: capacity[pattern] tokens a repetition, pattern: a tuple of sources.

    The k-th repetition costs 2k - 1 a token and nothing else costs anything, so a
    cheapest augmenting path is one through the lowest repetition that has any. Each
    repetition's capacity is added in turn and the flow made maximal by blocking
    flows, which gives the same as one shortest path after another.
    """
    nodes = {("p", p): i + 1 for i, p in enumerate(capacity)}
    for s in quota:
        nodes["s", s] = len(nodes) + 1
    sink = len(nodes) + 1
    graph: list[list[int]] = [[] for _ in range(sink + 1)]
    to, room = [], []

    def arc(a: int, b: int, c: float) -> int:
        for x, y, r in ((a, b, c), (b, a, 0.0)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
        return len(to) - 2

    taken = {p: arc(0, nodes["p", p], 0.0) for p in capacity}
    for p in capacity:
        for s in p:
            if s in quota:
                arc(nodes["p", p], nodes["s", s], float("inf"))
    for s, q in quota.items():
        arc(nodes["s", s], sink, q)
    least = 1e-9 * max(1.0, sum(quota.values()))
    for _ in range(most):
        for p, size in capacity.items():
            room[taken[p]] += float(size)
        while _blocking_flow(graph, to, room, sink, least):
            pass
    return {p: room[e ^ 1] for p, e in taken.items()}


def _blocking_flow(graph: list[list[int]], to: list[int], room: list[float], sink: int, least: float) -> bool:
    """Flow along shortest paths from node 0 until none of their length is left; whether there was any."""
    far, front = [-1] * len(graph), [0]
    far[0] = 0
    while front and far[sink] < 0:
        after = []
        for x in front:
            for e in graph[x]:
                if room[e] > least and far[to[e]] < 0:
                    far[to[e]] = far[x] + 1
                    after.append(to[e])
        front = after
    if far[sink] < 0:
        return False
    turn, path = [0] * len(graph), []
    while True:
        x = to[path[-1]] if path else 0
        if x == sink:
            step = min(room[e] for e in path)
            for e in path:
                room[e] -= step
                room[e ^ 1] += step
            # Back to before the first arc that has no room left.
            del path[next(i for i, e in enumerate(path) if room[e] <= least) :]
            continue
        while turn[x] < len(graph[x]):
            e = graph[x][turn[x]]
            if room[e] > least and far[to[e]] == far[x] + 1:
                path.append(e)
                break
            turn[x] += 1
        else:
            if not path:
                return True
            turn[to[path[-1] ^ 1]] += 1
            path.pop()


_SAME = ["_key", "_text"]


def _again(docs: DataFrame) -> DataFrame | None:
    """Ids and texts that several rows share, with the first of them; None if there are none, or no _row to tell rows apart by."""
    if "_row" not in docs.columns:
        return None
    again = cut(docs.groupBy(*_SAME).agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("_first")).where("n > 1"), "again")
    return None if again.isEmpty() else again


def _hashed(docs: DataFrame, again: DataFrame | None, seed: int = SEED) -> DataFrame:
    """docs with _pattern and _u, the row's hash. Rows that share id and text with another are told apart by _nth, which is 0 for all others."""
    if again is None:
        docs = docs.withColumn("_nth", F.lit(0).cast("long") if "_row" in docs.columns else F.lit(0))
    else:
        docs = joined_by_weight(docs, again, _SAME).withColumn("_nth", F.coalesce(F.col("_row") - F.col("_first"), F.lit(0))).drop("n", "_first")
    pattern = F.to_json(F.struct(F.array_sort(F.array_distinct("_sources")).alias("s")))
    return docs.withColumn("_pattern", pattern).withColumn("_u", F.xxhash64(F.lit(seed), *(c for c in ("_key", "_text", "_nth") if c in docs.columns)))


def _threshold(items: DataFrame, rests: DataFrame, known=F.broadcast) -> DataFrame:
    """(pattern, upto, more): the hash up to which the sizes of items(pattern, size, u) fit in rests(pattern, rest), and a few beyond it that fill the gap best."""
    items = cut(items.groupBy("pattern", "u").agg(F.sum("size").alias("size")), "hashes")
    left, at = known(rests), items
    for bits in (52, 40):
        bucket = F.shiftright("u", bits).alias("bucket")
        sums = at.join(left.select("pattern"), "pattern", "left_semi").groupBy("pattern", bucket).agg(F.sum("size").alias("size"))
        before = F.sum("size").over(W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
        # The last range that begins within the rest.
        sums = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(left.select("pattern", "rest"), "pattern").where("before <= rest")
        left = sums.groupBy("pattern").agg(F.max_by(F.struct("bucket", (F.col("rest") - F.col("before")).alias("rest")), "bucket").alias("b")).select("pattern", "b.*")
        left = known(cut(left, "ranges"))
        at = at.join(left.select("pattern", F.col("bucket").alias("_b")), "pattern").where(F.shiftright("u", bits) == F.col("_b")).drop("_b")
    run = F.sum("size").over(W.partitionBy("pattern").orderBy("u"))
    under = at.withColumn("run", run).join(left, "pattern").where("run <= rest").groupBy("pattern").agg(F.max(F.struct("run", "u")).alias("m"))
    # Without any of its last range a prefix ends before that range's first hash.
    found = left.join(under, "pattern", "left").select(
        "pattern",
        F.coalesce("m.u", F.shiftleft(F.col("bucket"), 40) - 1).alias("upto"),
        (F.col("rest") - F.coalesce("m.run", F.lit(0))).alias("gap"),
        F.array().cast("array<long>").alias("more"),
    )
    found = cut(found, "prefixes")
    for _ in range(FILLS):
        free = items.join(known(found), "pattern").where("u > upto AND NOT array_contains(more, u) AND abs(gap - size) < gap")
        best = free.groupBy("pattern").agg(F.min_by(F.struct("u", "size"), F.struct(F.abs(F.col("gap") - F.col("size")), "u")).alias("b"))
        found = found.join(best, "pattern", "left").select(
            "pattern", "upto", (F.col("gap") - F.coalesce("b.size", F.lit(0))).alias("gap"), F.when(F.col("b").isNull(), F.col("more")).otherwise(F.concat("more", F.array("b.u"))).alias("more")
        )
        found = cut(found, "fills")
    return found.select("pattern", "upto", "more")


def mix(docs: DataFrame, cycle: tuple[float, ...] = CYCLE, most: int = MOST, seed: int = SEED, limit: int = LIMIT) -> DataFrame:
    """docs(_key, _size, _sources, with _text and _row if keys repeat) and its other columns with _target, _source_size (of the first source) and _times."""
    hashed = cut(_hashed(docs, _again(docs), seed), "hashed")
    return _taken(hashed, _plan(hashed, cycle, most, limit), most)


def _plan(docs: DataFrame, cycle: tuple[float, ...] = CYCLE, most: int = MOST, limit: int = LIMIT) -> DataFrame:
    """What the mix takes of each pattern of docs(_pattern, _u, _size, _sources): (_pattern, whole, rest, _target, _source_size, upto, more)."""
    spark = docs.sparkSession
    found = docs.groupBy("_pattern").agg(F.first("_sources").alias("s"), F.sum("_size").alias("size")).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} membership patterns")
    # In an order of their own, so that of several cheapest flows reruns choose the same.
    found = sorted(found, key=lambda r: r["_pattern"])
    sizes: dict[str | None, int] = {}
    for r in found:
        for s in set(r.s):
            sizes[s] = sizes.get(s, 0) + r["size"]
    total = sum(r["size"] for r in found)
    scale = total / max(1, sum(sizes.values()))
    quota = {s: t * scale for s, t in targets(sizes, cycle, most).items()}
    capacity: dict[tuple, int] = {}
    for r in found:
        key = tuple(sorted(set(r.s), key=lambda s: (s is None, s or "")))
        capacity[key] = capacity.get(key, 0) + r["size"]
    flow = min_cost_flow(capacity, quota, most)
    rows = []
    for r in found:
        key = tuple(sorted(set(r.s), key=lambda s: (s is None, s or "")))
        whole = min(most, int(flow[key] / capacity[key] + 1e-9)) if capacity[key] else 0
        rest = flow[key] - whole * capacity[key] if whole < most else 0.0
        rows.append((r._pattern, whole, max(0.0, rest), quota[r.s[0]], sizes[r.s[0]]))
    schema = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("whole", T.IntegerType()), T.StructField("rest", T.DoubleType()), T.StructField("_target", T.DoubleType()), T.StructField("_source_size", T.LongType())])
    plan = spark.createDataFrame(rows, schema)
    known = F.broadcast if len(rows) <= KNOWN else lambda df: df
    upto = _threshold(docs.select(F.col("_pattern").alias("pattern"), F.col("_size").alias("size"), F.col("_u").alias("u")), plan.select("pattern", "rest"), known)
    return cut(plan.join(upto, "pattern", "left").withColumnRenamed("pattern", "_pattern"), "plan")


def _taken(docs: DataFrame, plan: DataFrame, most: int = MOST) -> DataFrame:
    """docs(_pattern, _u) with _target, _source_size and _times by their plan: each row tells by its own hash how often it is taken, so rows don't travel."""
    out = docs.join(F.broadcast(plan) if plan.count() <= KNOWN else plan, "_pattern")
    times = F.col("whole") + F.when((F.col("whole") < most) & ((F.col("_u") <= F.col("upto")) | F.array_contains("more", F.col("_u"))), 1).otherwise(0)
    return out.withColumn("_times", times).drop("_pattern", "_u", "_nth", "whole", "rest", "upto", "more")


def _sized(docs: DataFrame) -> DataFrame:
    """docs with what mix() needs; a row's number is settled by writing it."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"_size": size, "_sources": F.array("source"), "_key": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_text": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(_sized(table(spark, sf_dir, "documents")).select("doc_id", *_ASKED), "sizes")
    return mix(docs).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_times")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row as many times as it is taken."""
    rows = cut(_sized(docs.select(F.struct("*").alias("own"), "doc_id", "text", "source")).select("own", *_ASKED), "rows")
    again = _again(rows)
    plan = settled(lambda: _plan(cut(_hashed(rows.drop("own"), again), "hashed")), "plan")
    taken = _taken(_hashed(rows, again), plan).where("_times > 0")
    return taken.select("own", F.explode(F.sequence(F.lit(1), "_times"))).select("own.*")
