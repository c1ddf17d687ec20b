"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` points of a 63-bit ring; a group of rows (equal texts) sits at the hash of its text and
belongs to the next point clockwise. Loads are bounded: a shard takes ``rows / shards`` rows, rounded down or, for the
first shards of the ring's order, up. Rows beyond a full shard continue clockwise to the next point whose shard has room.
So counts differ by at most one, and a change of rows or shards moves few rows besides those that must move.

The rows of all arcs are counted with a narrow, range-sorted table (a hot group is split over many ranges, since ids
break its ties); the driver deals whole arc runs (one number for each arc and range) and Spark applies the runs by a join.
Slots number a shard's rows from 0 without gaps.

Defined results: a null text has no bytes, CRC 0 and a ring place of its own; null ids come first among equals; repeated
rows each get a slot; an empty table gives an empty result. Input columns named like the result's are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import q, written


def ring_points(shards: int, vnodes: int = 64) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, clockwise."""
    return sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") >> 1, s) for s in range(shards) for v in range(vnodes))


def bounded_runs(counts: list[int], owners: list[int], capacity: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc, [(shard, rows)] in order: its owner's share first, then where the rest went, clockwise."""
    room, runs = list(capacity), []
    for n, s in zip(counts, owners, strict=True):
        take = min(n, room[s])
        room[s] -= take
        runs.append([(s, take)] if take else [])
    for a, n in enumerate(counts):
        rest, at = n - sum(x for _, x in runs[a]), a
        while rest:
            at = (at + 1) % len(owners)
            take = min(rest, room[owners[at]])
            if take:
                room[owners[at]] -= take
                rest -= take
                runs[a].append((owners[at], take))
    return runs


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", vnodes: int = 64) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row; law ``rows``."""
    spark = docs.sparkSession
    text = q(text_col)
    points = ring_points(shards, vnodes)
    place = F.shiftrightunsigned(F.xxhash64(text), 1)
    narrow = docs.select(
        q(id_col).alias("id"), place.alias("place"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
    )
    ordered = narrow.repartitionByRange("place", "id", "crc").sortWithinPartitions("place", "id", "crc").withColumn("mid", F.monotonically_increasing_id())
    kept = written(ordered, "shard-rows")
    arc = _arc_of([p for p, _ in points])
    kept = kept.select("*", F.shiftright("mid", 33).alias("pid"), F.col("mid").bitwiseAND((1 << 33) - 1).alias("idx"), arc("place").alias("arc"))
    runs = kept.groupBy("pid", "arc").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("lo")).collect()
    segments = place_runs([(r["pid"], r["arc"], r["n"], r["lo"]) for r in runs], [s for _, s in points], shards)
    # at most one row for each pair of range and arc that meet, and one for each place where a shard fills up
    table = spark.createDataFrame(segments or [(-1, -1, 0, 0, 0, 0)], "pid long, arc long, a long, b long, shard int, slot0 long")
    hit = kept.join(F.broadcast(table), ["pid", "arc"]).where("idx >= a and idx < b")
    return hit.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        (F.col("slot0") + F.col("idx") - F.col("a")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _arc_of(places: list[int]):
    """The number of the point that a place belongs to: the first at or after it, clockwise."""

    @F.arrow_udf("long")
    def arc(values):
        import numpy as np
        import pyarrow as pa

        return pa.array(np.searchsorted(np.array(places, np.int64), values.to_numpy(zero_copy_only=False), "left") % len(places))

    return arc


def place_runs(runs: list[tuple[int, int, int, int]], owners: list[int], shards: int) -> list[tuple]:
    """(pid, arc, from, to, shard, first slot): where each run of a range's rows goes. ``runs``: (pid, arc, n, lo)."""
    total = sum(r[2] for r in runs)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    counts = [0] * len(owners)
    for _, a, n, _ in runs:
        counts[a] += n
    dealt = bounded_runs(counts, owners, capacity)
    used, spans = [0] * shards, []
    for run in dealt:
        at, ends, out = 0, [], []
        for s, n in run:
            out.append((at, at + n, s, used[s]))
            used[s] += n
            at += n
            ends.append(at)
        spans.append((ends, out))
    done, segments = [0] * len(owners), []
    for pid, a, n, lo in sorted(runs):
        first, last = done[a], done[a] + n
        done[a] = last
        ends, out = spans[a]
        for x, y, s, slot in out[bisect.bisect_right(ends, first) :]:
            if x >= last:
                break
            u, v = max(x, first), min(y, last)
            segments.append((pid, a, lo + u - first, lo + v - first, s, slot + u - x))
    return segments
