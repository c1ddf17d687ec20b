"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by their number of distinct shingles into classes with upper bounds 8, 16, 32, ... A long
document would drown a short item's Jaccard similarity, so for each class it is searched in windows of twice the
class's bound, starting every bound: each passage as long as an item of the class lies within one window, and the
similarity of item and window stays above 0.19 at a containment of 0.8. Signatures are one-permutation MinHash with
128 bins; one equal bin makes a candidate (expected at least 24 equal bins at the threshold for items of more shingles
than bins). An item of up to 8 shingles has few bins to agree in, so it is looked up exactly: a document that holds all
but m of its shingles holds one of any m + 1 of them, and each place of one of those makes a candidate. Candidates are
verified on the whole document: the share of the item's distinct shingles, as words, that the document holds anywhere.

An item of fewer words than a shingle is one shingle of all its words, looked up exactly among the document's runs of as
many words.

The items are sent to the tasks in blocks of at most ``max_words_per_block`` words (as hashes and text, about 16 bytes a
word). Beyond one block the documents are passed over once for each block, whose hits are written before the next block
is sent: no task holds more than one block, whatever the benchmark's size.

Words are maximal runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased.

Defined results: null and empty texts hold no shingle and match nothing; repeated rows and repeated items each give
their own rows; an empty table on either side gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import ascii_fold_table, q, texts, written

_FOLD = ascii_fold_table()
BINS_BITS = 7
_MUL = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22
EXACT_BOUND = 8  # the class that is looked up by shingles, not by bins


def folded_words(b: bytes | None) -> list[bytes]:
    return b.translate(_FOLD).split() if b else []


class _Hashes(dict):
    """word -> XXH64 of it; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A 64-bit hash for each shingle of k words, in text order; one for a shorter text, none without words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    a = np.array([_HASHES[w] for w in words], np.uint64)
    m = min(k, n)
    h = a[: n - m + 1].copy()
    for j in range(1, m):
        h *= _MUL
        h += a[j : n - m + 1 + j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def size_class(n: int) -> int:
    """The upper bound of the class of an item with n distinct shingles."""
    return max(EXACT_BOUND, 1 << (n - 1).bit_length())


def shingle_words(text: bytes, k: int) -> set:
    """The distinct shingles of an item's text as tuples of words."""
    words = folded_words(text)
    m = min(k, len(words))
    return {tuple(words[i : i + m]) for i in range(len(words) - m + 1)}


class ItemIndex:
    """The signatures of one block of test items, and their texts and sorted shingle hashes in flat arrays."""

    def __init__(self, items: list[tuple], k: int, threshold: float):
        self.k, self.threshold = k, threshold
        self.ids, self.texts, hashes_of, entries = [], [], [], {}
        short: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = folded_words(text)
            hashes = np.unique(shingle_hashes(words, k))
            if not len(hashes):
                continue
            at = len(self.ids)
            self.ids.append(item_id)
            self.texts.append(text)
            hashes_of.append(hashes)
            if len(words) < k:
                short.setdefault(len(words), []).append((int(hashes[0]), at))
                continue
            if size_class(len(hashes)) == EXACT_BOUND:
                shingles = len(shingle_words(text, k))
                first = np.arange(min(len(hashes), shingles - math.ceil(threshold * shingles - 1e-9) + 1))
            else:
                first = np.unique(hashes >> np.uint64(64 - BINS_BITS), return_index=True)[1]
            entries.setdefault(size_class(len(hashes)), []).append((hashes[first], np.full(len(first), at)))
        self.ends = np.cumsum([0, *map(len, hashes_of)])
        self.hashes = np.concatenate(hashes_of) if hashes_of else np.empty(0, np.uint64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.classes, self.short = {}, {}
        for bound, parts in entries.items():
            h, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((at, h))
            self.classes[bound] = (h[order], at[order])
            self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        for n, pairs in short.items():
            pairs.sort()
            self.short[n] = (np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs]))

    def short_candidates(self, words: list[bytes]) -> set[int]:
        """Items of fewer words than a shingle whose hash is that of a run of the text's words."""
        out: set[int] = set()
        for n, (sig, item) in self.short.items():
            if len(words) >= n:
                h = np.unique(shingle_hashes(words, n))
                lo, hi = np.searchsorted(sig, h, "left"), np.searchsorted(sig, h, "right")
                for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                    out.update(item[a:b].tolist())
        return out

    def candidates(self, h: np.ndarray) -> set[int]:
        """Items of few shingles that share one of those looked up, and items whose signature agrees in a bin with that
        of one of the text's windows."""
        maybe = np.nonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])[0]
        out: set[int] = set()
        if not len(maybe):
            return out
        bins = h >> np.uint64(64 - BINS_BITS)
        for bound, (sig, item) in self.classes.items():
            lo = np.searchsorted(sig, h[maybe], "left")
            hi = np.searchsorted(sig, h[maybe], "right")
            if bound == EXACT_BOUND:
                for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                    out.update(item[a:b].tolist())
                continue
            last = max(0, -(-(len(h) - 2 * bound) // bound))
            for p, a, b in zip(maybe[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                if out.issuperset(item[a:b].tolist()):
                    continue
                for w in {min(p // bound, last), min(max(0, p // bound - 1), last)}:
                    window = slice(w * bound, w * bound + 2 * bound)
                    if not (h[window][bins[window] == bins[p]] < h[p]).any():  # the window's minimum in this bin
                        out.update(item[a:b].tolist())
                        break
        return out

    def matches(self, b: bytes | None) -> list[tuple[int, int, int]]:
        """(item, shared shingles, item's shingles) for each item contained to at least the threshold."""
        words = folded_words(b)
        if not words:
            return []
        own, out = {}, []

        def runs(m):
            if m not in own:
                own[m] = {tuple(words[i : i + m]) for i in range(len(words) - m + 1)}
            return own[m]

        for at in sorted(self.short_candidates(words)):
            item = tuple(folded_words(self.texts[at]))
            if item in runs(len(item)):
                out.append((at, 1, 1))
        if len(words) < self.k:
            return out
        h = shingle_hashes(words, self.k)
        for at in sorted(self.candidates(h)):
            hashes = self.hashes[self.ends[at] : self.ends[at + 1]]
            if np.isin(hashes, h).sum() < math.ceil(self.threshold * len(hashes) - 1e-9):
                continue
            shingles = shingle_words(self.texts[at], self.k)
            shared = len(shingles & runs(self.k))
            if shared >= math.ceil(self.threshold * len(shingles) - 1e-9):
                out.append((at, shared, len(shingles)))
        return out


def item_blocks(benchmark: DataFrame, k: int, threshold: float, id_col: str, text_col: str, max_words_per_block: int):
    """The indices of the benchmark's blocks and how many blocks there are; one block is held at a time."""
    items = benchmark.select(q(id_col).alias("id"), q(text_col).alias("text")).where("text is not null")
    words = items.select(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-words // (4 * max_words_per_block)))
    for i in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i)
        rows = [(r["id"], r["text"].encode()) for r in part.collect()]
        index = ItemIndex(sorted(rows, key=lambda r: (r[0] is None, str(r[0]), r[1])), k, threshold)
        if index.ids:
            yield index, blocks


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_words_per_block: int = 10_000_000) -> DataFrame:
    """(doc id, item id, shared, item_shingles, containment) for each item that a document contains. Nothing is shuffled."""
    rows = docs.select(q(id_col).alias("id"), q(text_col).alias("text"))
    found = _pairs(rows, benchmark, threshold, shingle_words, item_col, item_text_col, max_words_per_block)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "shared", "item_shingles", "containment")


def _pairs(rows: DataFrame, benchmark: DataFrame, threshold: float, k: int, item_col: str, item_text_col: str, max_words_per_block: int) -> DataFrame:
    spark = rows.sparkSession
    item_type = benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("item", item_type), *[T.StructField(c, T.LongType()) for c in ("shared", "item_shingles")], T.StructField("containment", T.DoubleType())])
    out = None
    for index, blocks in item_blocks(benchmark, k, threshold, item_col, item_text_col, max_words_per_block):
        shared_index = spark.sparkContext.broadcast(index)

        def search(batches, shared_index=shared_index):
            import pyarrow as pa

            index = shared_index.value
            for batch in batches:
                rows = [(i, *m) for i, b in enumerate(texts(batch.column(1))) for m in index.matches(b)]
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                items = pa.array([index.ids[r[1]] for r in rows])
                yield pa.RecordBatch.from_arrays(
                    [ids, items.cast(to_arrow_type(item_type)), pa.array([r[2] for r in rows], pa.int64()),
                     pa.array([r[3] for r in rows], pa.int64()), pa.array([r[2] / r[3] for r in rows], pa.float64())],
                    names=["id", "item", "shared", "item_shingles", "containment"],
                )

        part = rows.where("text is not null").mapInArrow(search, schema)
        if blocks > 1:
            part = written(part, "contaminated")
            shared_index.destroy()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def uncontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, shingle_words: int = 5, text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", max_words_per_block: int = 10_000_000) -> DataFrame:
    """The rows of ``docs`` whose text contains no item of the benchmark. Of a benchmark of one block no row is shuffled;
    beyond one block the rows are joined to the hashes of the texts found, and a hash is taken with the text's length."""
    spark = docs.sparkSession
    words = benchmark.select(F.sum(F.length(q(item_text_col)))).first()[0] or 0
    if words <= 4 * max_words_per_block:
        kept = F.lit(True)
        for index, _ in item_blocks(benchmark, shingle_words, threshold, item_col, item_text_col, max_words_per_block):
            shared_index = spark.sparkContext.broadcast(index)

            @F.arrow_udf("boolean")
            def clean(values, shared_index=shared_index):
                import pyarrow as pa

                return pa.array([not shared_index.value.matches(b) for b in texts(values)], pa.bool_())

            kept = clean(q(text_col))
        return docs.where(kept).select(*[q(c) for c in docs.columns])
    key = F.concat_ws(":", F.xxhash64(q(text_col)).cast("string"), F.octet_length(q(text_col)).cast("string"))
    hit = _pairs(docs.select(key.alias("id"), q(text_col).alias("text")), benchmark, threshold, shingle_words, item_col, item_text_col, max_words_per_block)
    return docs.join(written(hit.select(F.col("id").alias("__lf_hit")).distinct(), "contaminated-texts"), key == F.col("__lf_hit"), "left_anti")
