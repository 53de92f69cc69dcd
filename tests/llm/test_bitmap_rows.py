"""A bitmap comes to the driver in few rows, whatever the number of values in it."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tallyforge.llm import common


def test_words_come_in_stretches(spark, monkeypatch):
    sent = []
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(DataFrame, name, lambda self, f=getattr(DataFrame, name): sent.append(len(out := f(self))) or out)
    hashes = spark.range(100_000).select(F.xxhash64("id").alias("h"))
    values = np.array([r.h for r in hashes.collect()], np.int64)
    for h, n, most in ((hashes, 100_000, 1 << 28), (hashes, 100_000, 1 << 18), (hashes.limit(3), 3, 1 << 28), (hashes.limit(0), 0, 1 << 28)):
        sent.clear()
        words = common.bitmap(h, most)
        assert max(sent) <= -(-len(words) // common.STRETCH)
        bits = 64 * len(words)
        assert bits == max(common.LEAST_BITS, min(most, 1 << max(0, (16 * n - 1)).bit_length()))
        expected = np.zeros(len(words), np.uint64)
        mine = np.array([r.h for r in h.collect()], np.int64).view(np.uint64)
        at = mine >> np.uint64(64 - (bits.bit_length() - 1))
        np.bitwise_or.at(expected, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        assert (words == expected).all() and common.marked(words, mine.view(np.int64)).all()
    assert common.marked(common.bitmap(hashes, 1 << 30), values).all() and not common.marked(common.bitmap(hashes), values ^ (1 << 62)).all()
