"""The pipeline's near_duplicates stage against brute force on planted near copies."""

import numpy as np
import pytest

import corpus_pipeline
from lumenframe.llm import near_copies


def planted():
    rng = np.random.default_rng(11)
    common = [f"common{i}" for i in range(12)]
    rows = []
    for base in range(40):
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(40, 300)))] + common
        rows.append(" ".join(words))
        for copy in range(5):
            near = list(words)
            for at in rng.integers(0, len(near), 1 + copy * len(near) // 200):
                near[at] = f"new{rng.integers(10**6)}"
            rows.append(" ".join(near).upper() if copy == 1 else " ".join(near))
    hot = [f"h{x}" for x in range(150)]
    for _ in range(60):
        near = list(hot)
        for at in rng.integers(0, 150, int(rng.integers(0, 6))):
            near[at] = f"new{rng.integers(10**6)}"
        rows.append(" ".join(near))
    rows += [None, "", " \n", "one two", "One  TWO", "one", rows[0]]
    return list(enumerate(rows))


def brute_force(rows, k=5):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids[a + 1 :]:
            both = len(sets[a] & sets[b])
            if 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [4, 2048])
def test_classes_are_those_of_brute_force(spark, block):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df, block=block).collect()}
    assert got == brute_force(rows)


def test_stage_keeps_one_of_each_class(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = set(brute_force(rows).values())
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()} == want
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), "").count() == 0
