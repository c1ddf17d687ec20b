"""Mixing sources to target token weights by entropy balancing.

Each document gets a rate: the rates nearest to one in entropy that meet a token target for every source, with no rate
above ``max_copies``. The convex dual has one multiplier a source; the rate is ``min(max_copies, exp(multiplier * size /
mean size))``. Newton iterations (guarded by a bracket) run on the counts of (source, size), aggregated by Spark in each
step. Rates are then rounded to whole copies by error feedback: each source's documents are dealt by a hash to buckets of
its own, one for each 1024 of its rows, and in each bucket, from the largest to the smallest, a document is rounded so
that the running difference shrinks. The difference left is about that of the smallest documents of each bucket, however
many other sources there are, and a source that holds a third of all rows is spread over many buckets. Equal input gives
equal output, whatever the partitioning.

Only one row for each source reaches the driver (at most ``max_sources``; more is an error, as sources are categories).

Defined results: a null or empty text has size 0 and copies 1; a null source
is a source of its own, last in order; repeated rows are dealt and rounded one by one; an empty table gives an empty
result; input columns named like the result's (``size, source_size, target, copies, taken``) are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import q, release, word_count, written

BUCKET_ROWS = 1024


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> dict:
    """Target of each source: ``share`` of all sizes by weight (cycled over the sources by code point, null last), at
    most ``cap`` times the source's size; what is above goes to the others by weight."""
    order = sorted(sizes, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    limit = {s: cap * n for s, n in order}
    out: dict = {}
    left, open_ = share * sum(n for _, n in order), [s for s, _ in order]
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > limit[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: limit[s] for s in over}
        left -= sum(limit[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return {s: float(v) for s, v in out.items()}


def _key(source: Column) -> Column:
    """The source as a non-null key: null apart from every string."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def solve(histogram: DataFrame, totals: dict, targets: dict, cap: float, tolerance: float = 1e-7, max_rounds: int = 80) -> dict:
    """The dual's multipliers by source key. ``histogram``: (key, size, n), size over 0."""
    spark = histogram.sparkSession
    mean = {k: t["size"] / max(1, t["rows"]) for k, t in totals.items()}
    lam = {k: 0.0 for k in totals}
    low, high = {k: -math.inf for k in totals}, {k: math.inf for k in totals}
    for k, t in totals.items():
        if t["size"] and targets[k] >= cap * t["size"] * (1 - 1e-12):
            lam[k] = math.inf
    todo = {k for k, t in totals.items() if t["size"] and math.isfinite(lam[k])}
    for _ in range(max_rounds):
        if not todo:
            break
        now = spark.createDataFrame([(k, lam[k], mean[k]) for k in sorted(todo)], "key string, lam double, mean double")
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.least(F.lit(60.0), F.col("lam") * x)))
        rows = (
            histogram.join(F.broadcast(now), "key").select("key", x.alias("x"), rate.alias("w"), (F.col("n") * F.col("size")).alias("t"))
            .groupBy("key").agg(F.sum(F.col("t") * F.col("w")).alias("g"), F.sum(F.when(F.col("w") < cap, F.col("t") * F.col("w") * F.col("x")).otherwise(0.0)).alias("h")).collect()
        )
        for r in rows:
            k, gap = r["key"], r["g"] - targets[r["key"]]
            if abs(gap) <= tolerance * max(1.0, targets[k]):
                todo.discard(k)
                continue
            if gap > 0:
                high[k] = min(high[k], lam[k])
            else:
                low[k] = max(low[k], lam[k])
            step = lam[k] - gap / r["h"] if r["h"] > 0 else math.nan
            if not (low[k] < step < high[k]):
                a, b = low[k], high[k]
                step = (a + b) / 2 if math.isfinite(a) and math.isfinite(b) else 2 * lam[k] + 1 if gap < 0 else 2 * lam[k] - 1
            lam[k] = step
            if math.isfinite(low[k]) and math.isfinite(high[k]) and high[k] - low[k] < 1e-12 * max(1, abs(step)):
                todo.discard(k)
    return {k: (lam[k], mean[k]) for k in totals}


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_copies: int = 2, source_col: str = "source",
        text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, max_sources: int = 100_000) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with size, source_size, target, copies and taken."""
    spark = docs.sparkSession
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {"size", "source_size", "target", "copies", "taken"}]
    base = docs.select(
        *[q(c).alias(f"c{i}") for i, c in enumerate(names)], _key(q(source_col)).alias("key"),
        word_count(q(text_col)).alias("size"), F.xxhash64(q(id_col), q(source_col), q(text_col)).alias("deal"),
    )
    sizes = written(docs.select(_key(q(source_col)).alias("key"), word_count(q(text_col)).alias("size")).groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    rows = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("rows")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"over {max_sources} sources; raise max_sources")
    totals = {r["key"]: {"size": r["size"], "rows": r["rows"]} for r in rows}
    plain = {k: None if k == "-" else k[1:] for k in totals}
    by_source = source_targets([(plain[k], t["size"]) for k, t in totals.items()], weights, share, max_copies)
    targets = {k: by_source[plain[k]] for k in totals}
    tilt = solve(sizes.where("size > 0"), totals, targets, max_copies)
    release(sizes)
    buckets = spark.createDataFrame([(k, -(-t["rows"] // BUCKET_ROWS)) for k, t in totals.items() if t["rows"] > BUCKET_ROWS], "key string, buckets long")
    table = {k: (float(totals[k]["size"]), targets[k], *tilt[k]) for k in totals}
    shared = spark.sparkContext.broadcast(table)

    def copies(batches):
        import pyarrow as pa

        carry: tuple = (None, 0.0)
        for b in batches:
            if not len(b):
                continue
            keys = b.column(len(names)).to_pylist()
            size = b.column(len(names) + 1).to_numpy().astype(float)
            bucket = b.column(len(names) + 2).to_numpy().tolist()
            info = np.array([shared.value[k] for k in keys])
            with np.errstate(invalid="ignore", over="ignore"):
                rate = np.where(size > 0, np.minimum(max_copies, np.exp(np.minimum(60, info[:, 2] * size / np.maximum(info[:, 3], 1e-9)))), 1.0)
            n = np.zeros(len(size), np.int64)
            last, error = carry
            for i, (c, w, r) in enumerate(zip(size.tolist(), rate.tolist(), zip(bucket, keys, strict=True), strict=True)):
                if r != last:
                    last, error = r, 0.0
                low = math.floor(w)
                n[i] = k = low + (w > low and 2 * (error + (w - low) * c) >= c)
                error += (w - k) * c
            carry = (last, error)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(names)], pa.array(size.astype(np.int64)), pa.array(info[:, 0].astype(np.int64)), pa.array(info[:, 1]), pa.array(n), pa.array(n * size.astype(np.int64))],
                names=[*[f"c{i}" for i in range(len(names))], "size", "source_size", "target", "copies", "taken"],
            )

    hashed = [F.col(f"c{i}") for i, c in enumerate(names) if "map<" not in docs.schema[c].dataType.simpleString()]  # equal sizes: by all columns
    dealt = base.join(F.broadcast(buckets), "key", "left").select(
        *[f"c{i}" for i in range(len(names))], "key", "size", F.pmod("deal", F.coalesce("buckets", F.lit(1))).alias("deal"), (F.xxhash64(*hashed) if hashed else F.lit(0)).alias("tie"),
    ).repartition("key", "deal").sortWithinPartitions("deal", "key", F.desc("size"), "tie")
    kinds = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)]
    schema = T.StructType(kinds + [T.StructField(c, T.DoubleType() if c == "target" else T.LongType()) for c in ("size", "source_size", "target", "copies", "taken")])
    out = dealt.mapInArrow(copies, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "size", "source_size", "target", "copies", "taken")


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed rows, each as often as its copies say, with ``columns`` only."""
    return mixed.where("copies > 0").withColumn("__lf_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[q(c) for c in columns])
