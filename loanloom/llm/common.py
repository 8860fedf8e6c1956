"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, VT, FF and CR.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a private one only in local mode where it is unset."""
    context = spark.sparkContext
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="loanloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: its lineage ends there.

    A lost executor then costs a read of that table and not the work behind it.
    The table stays until :func:`discard` or until the folder's owner cleans it.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    spark = df.sparkSession
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    _written.append(out)
    # the exchanges behind the table are garbage now; Spark deletes their files
    # when the driver's collector finds them, which may else be half an hour later
    gc.collect()
    spark._jvm.System.gc()
    return out


#: Tables written since the last call of :func:`taken`.
_written: list[DataFrame] = []


def taken() -> list[DataFrame]:
    """The tables written since the last call."""
    out = list(_written)
    _written.clear()
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables written by :func:`saved` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a membership map: 2 MB, whatever the number of keys.
MAP_BITS = 1 << 24


def membership(keys: DataFrame):
    """A broadcast bit map of a table's one column of longs: a key that it lacks is not in the table.

    It spares keys that are surely absent an exchange; the others still need an
    exact join.  With very many keys it spares less, and nothing else changes.
    """
    place = F.pmod(F.col(keys.columns[0]), F.lit(MAP_BITS))
    bits = (
        keys.select(F.floor(place / 32768).alias("part"), (place % 32768).alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()  # MAP_BITS in all
    )
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in bits:
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out)


def perhaps(df: DataFrame, key: str, members, inside: bool = True) -> DataFrame:
    """Rows whose ``key`` is in a membership map (not in it: ``inside`` False)."""
    at = df.columns.index(key)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        place = rows.column(at).to_numpy(zero_copy_only=False).astype(np.int64) & (MAP_BITS - 1)
        held = (members.value[place >> 3] >> (place & 7)) & 1
        return rows.filter(pa.array(held == inside))

    return by_batch(df, batch, df.schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` has."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


@contextmanager
def small_batches(spark: SparkSession, most: str = "4m"):
    """Inside, Arrow batches hold about ``most`` bytes, which bounds what workers and buffers take."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def finished(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own; the working tables written since :func:`taken` was last called go."""
    working = taken()
    out = saved(df)
    discard(*working)
    taken()
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column) -> Column:
    """crc32 of the id written as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def by_batch(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str,
    text: int | None = None,
    most: int = 1 << 22,
) -> DataFrame:
    """``function`` on every Arrow batch of ``df``; with ``text``, the number of a column, on ``most`` bytes of it at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in [batch] if text is None else slices(batch, text, most):
                    out = function(part)
                    if out is not None and out.num_rows:
                        yield out
        finally:  # the worker may stay for other stages
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def slices(rows: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of ``rows`` with about ``most`` bytes of text in a column, a longer text alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(rows.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < rows.num_rows:
        done = int(size[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(size, done + most, "right")))
        yield rows.slice(low, high - low)
        low = high


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    A-Z is lowered.  Fewer words than ``size``: the whole sequence is the one
    shingle.  No words: empty.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashes(words)
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), np.uint64)
    for k in range(min(size, len(h))):
        out = mixed(out + h[k : k + n])
    return np.unique(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` for ``counts[i]`` values, one i after the other."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - starts, counts)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, root)``: the smallest node that each node of ``edges`` can reach.

    Alternates the large-star and small-star steps until nothing changes; both
    keep one row per edge at most, and each round is written to the shared
    folder.  Takes a number of rounds logarithmic in the size of a component.
    """
    links = (
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .filter("u <> v")
        .distinct()
    )
    links = saved(links)
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                      F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        after = saved(small)
        now = tuple(
            after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        )
        discard(links)
        links = after
        if now == before:
            break
        before = now
    out = links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return out.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
