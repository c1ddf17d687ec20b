"""op9_mixing: targets are met by each of many sources of few rows."""

from collections import Counter

import numpy as np

from lumenframe.llm import mixing


def test_many_small_sources_meet_their_targets(spark):
    rng = np.random.default_rng(4)
    size = np.maximum(1, rng.lognormal(3.5, 0.8, 20_000).astype(int))
    d = spark.createDataFrame([(i, "w " * int(n), f"s{i % 200:03d}") for i, n in enumerate(size)], "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.mix(d, keep=["doc_id", "source"]).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    off = np.array([abs(taken[s] - t) / t for s, t in target.items()])
    assert len(off) == 200 and off.max() < 0.005


def test_rows_that_differ_in_an_array_alone_are_dealt_alike_in_reruns(spark):
    rows = [(i // 4, "w " * 10, "a" if i % 2 else None, [i * 0.5], float(i)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, `v 1` array<double>, x double")
    a, b = (sorted((tuple(r["v 1"]), r.copies) for r in mixing.mix(x).collect()) for x in (d, d.repartition(9, "x")))
    assert a == b and len(a) == 400
