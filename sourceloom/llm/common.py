"""Small helpers that the operators share: tables, lineage cuts, folds and cached word hashes."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.session import shared_dir

#: A word of the contracts: everything between white space of ASCII.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = r"[\x20\x09-\x0D]+"
#: Words that a worker's cache holds before it is emptied.
CACHE_WORDS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in SHIPPED:
        return
    SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="sourceloom-")) / "sourceloom_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))


def work_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; only a local master without that setting gets a temporary one."""
    return shared_dir(spark, "llm")


def settle(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete settled tables that nothing reads any more: all that was made from them is settled itself."""
    for path in {getattr(t, "settled_at", None) for t in tables} - {None}:
        spark = SparkSession.getActiveSession()
        name = spark._jvm.org.apache.hadoop.fs.Path(path)
        name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows with large arrays go to Python workers in smaller batches while this holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def forget() -> None:
    """Let the driver notice which shuffles are no longer referenced, so that their files are removed."""
    gc.collect()
    SparkSession.getActiveSession().sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers are reused, and what earlier tasks took would add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def fold(doc_id: str, folds: int, held: int) -> Column:
    """True for rows whose crc32 of the id as text leaves ``held``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % F.lit(folds) == F.lit(held)


class WordHashes(dict):
    """word -> 32-bit hash, computed once per worker; emptied when it holds ``CACHE_WORDS``."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


WORD_HASHES = WordHashes()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(WORD_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def bounded_ids(ids: DataFrame, doc_id: str, rows: int) -> DataFrame:
    """The ``rows`` ids that come first by hash: a fixed sample whose size does not grow with the table."""
    return ids.orderBy(F.xxhash64(doc_id), doc_id).limit(rows)


def sampled_texts(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, max_chars: int) -> DataFrame:
    """Rows of ``docs`` with an id in ``ids`` (a bounded sample, so it is broadcast), one per id.

    Texts of more than ``max_chars`` are left out of the sample, which bounds its bytes; they are
    scored like all others.
    """
    found = docs.select(F.col(doc_id).alias("sample_id"), F.col(text).alias("sample_text")).where(
        F.length("sample_text") <= max_chars
    )
    ship(docs.sparkSession)
    ids = ids.withColumnRenamed(doc_id, "sample_id")
    return found.join(F.broadcast(ids), "sample_id").dropDuplicates(["sample_id"])


def without(docs: DataFrame, names: Iterable[str]) -> DataFrame:
    """``docs`` without columns of these names, which an operator is about to add."""
    clash = {n.lower() for n in names}
    return docs.drop(*[c for c in docs.columns if c.lower() in clash])
