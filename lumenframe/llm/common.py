"""Shared pieces of the corpus operators: shared-folder tables, byte-level text helpers, column guards."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words in every contract of this package.
SPACE = b" \t\n\x0b\x0c\r"
WORD_REGEX = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Unset on a local master, a temporary folder is made and set; unset on a cluster it is an error, since a
    machine-local folder would not be seen by the other machines.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumenframe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back: lineage ends here, and a lost executor
    costs a re-read, not a recomputation. ``files``: at most so many, for tables known to be small beside the number of
    shuffle partitions, which would else give a file each."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenframe_path = path
    return out


def files_for(spark: SparkSession, rows: int, rows_per_file: int) -> int:
    """How many files a table of ``rows`` takes: as many as there are cores, or one for each ``rows_per_file``."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_file))


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    path = getattr(df, "_lumenframe_path", None)
    if path:
        release_path(df.sparkSession, path)


def release_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names clash (in any letter case) with ``names``."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def q(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def raw(column) -> list:
    """The values of an Arrow string column as bytes (None for null), without decoding them."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def texts(column, step: int = 256):
    """The values of :func:`raw`, with the bytes of ``step`` rows at a time in memory."""
    for i in range(0, len(column), step):
        yield from raw(column.slice(i, step))


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the bytes of an Arrow batch sent to a Python worker. Whole texts differ much in length, so a bound on
    rows alone leaves a worker's memory open. A smaller bound that the session has stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    in_bytes = lambda v: int(v.rstrip("bkmgBKMG") or 0) * units.get(v[-1].lower(), 1)
    if not now or in_bytes(now) > in_bytes(size) or in_bytes(now) <= 0:
        spark.conf.set(key, size)


def key_groups(batches):
    """The columns of sorted batches in pieces that hold whole (key, part) groups."""
    import numpy as np

    held = None
    for b in batches:
        if not len(b):
            continue
        now = [c.to_numpy() for c in b.columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = np.nonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[0]
        cut = int(last[-1]) + 1 if len(last) else 0
        held = [x[cut:] for x in now]
        if cut:
            yield [x[:cut] for x in now]
    if held is not None:
        yield held


def ascii_fold_table() -> bytes:
    """bytes.translate table: A-Z to a-z, every other ASCII byte but digits and letters to a space."""
    return bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))


#: The same word rule for SQL engines: runs of ASCII letters, digits and any non-ASCII character.
FOLDED_WORD_REGEX = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in a text; null counts 0."""

    @F.arrow_udf("long")
    def count(values):
        import pyarrow as pa

        return pa.array([0 if b is None else len(b.split()) for b in texts(values)], pa.int64())

    return count(text)
