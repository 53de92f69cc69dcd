"""Tables that an explode has made large are never broadcast, though Spark takes them for as small as what they are made of."""

from pyspark.sql import functions as F

from tallyforge.llm import common, simhash_dedup


def broadcasts(df, column):
    """Whether a broadcast in df's plan holds rows of a column."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    held = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            inner = lines[i + 1 :]
            end = next((k for k, x in enumerate(inner) if depth(x) <= depth(line)), len(inner))
            held += [x for x in inner[:end] if "Generate explode" in x and column in x]
    return held


def test_fingerprints_asked_for_are_shuffled(spark):
    prints = common.cut(spark.range(2000).select(F.xxhash64("id").alias("print")), "prints")
    found = simhash_dedup.near_links(prints, bucket=2)
    assert not broadcasts(found, "half")

