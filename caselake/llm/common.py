"""What the training-data operators share: words, hashes, batches, and tables that cut lineage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

U = np.uint64
_ONE = U(1)
#: Odd multipliers of the polynomial hashes (fixed values), with their inverses modulo 2^64.
BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))
INVERSES = tuple(U(pow(int(b), -1, 1 << 64)) for b in BASES)


#: Rows and bytes that a Python worker gets at a time; texts are long, so Spark's own 10,000 rows are too many.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches for whole texts, where the session does not say otherwise."""
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def read_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return df.select(*columns) if columns else df


#: The stand-in folders of local sessions, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one stands in only on a local master; a cluster must name its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="caselake-")
    return _LOCAL[context.applicationId]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what the work on each has freed goes back to the system, as a worker outlives its tasks."""
    for batch in batches:
        yield batch
        del batch
        if _trim:
            _trim(0)


class Scratch:
    """Tables in the shared folder that cut lineage, so that a lost executor costs one step only."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        df.write.parquet(path)
        schema = df.schema
        del df
        self.release()
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Let Spark's context cleaner drop the shuffle files of finished steps now."""
        gc.collect()
        self.spark._jvm.System.gc()


#: A key of more rows than HOT_ROWS, and than a HOT_KEYS-th of all rows, is dealt to several tasks; there are HOT_KEYS such keys at most.
HOT_ROWS, HOT_KEYS = 2_000, 10_000


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], total: int, spread: list[str]) -> DataFrame:
    """Inner join of ``big`` (``total`` rows) with ``small``, whose keys are unique and whose column ``n`` says how many rows of ``big`` each key has.

    Rows of a hot key are dealt by ``spread`` to as many parts as it needs, and its row of ``small`` goes to each of them. The
    list of hot keys is broadcast: HOT_KEYS rows at most, as each stands for more than total / HOT_KEYS rows. ``small`` should be a table, as it is read twice.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    parts = F.when(F.col("n") > limit, F.ceil(F.col("n") / limit).cast("int")).otherwise(1)
    hot = F.broadcast(small.where(F.col("n") > limit).select(*keys, parts.alias("__parts")))
    part = F.pmod(F.xxhash64(*spread), F.coalesce("__parts", F.lit(1))).cast("int")
    dealt = big.join(hot, keys, "left").withColumn("__part", part).drop("__parts")
    copies = small.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return dealt.join(copies, [*keys, "__part"]).drop("__part")


def crc_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


class WordHashes(dict):
    """64-bit hashes of words, kept while there are fewer than ``limit``."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


def blocks(items: list, sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``most`` units; an item larger than that stands alone."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(items):
        yield begin, len(items)


def hash_words(lists: list[list[str]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one list after the other, and where each list starts (one more at the end)."""
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    look = cache.__getitem__
    return np.fromiter(map(look, chain.from_iterable(lists)), U, int(starts[-1])), starts


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (fixed constants)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def times(base: np.uint64, k: int) -> np.uint64:
    return U(int(base) * k & 0xFFFFFFFFFFFFFFFF)


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64 random bits."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


class Rolling:
    """Polynomial hash of any span of a sequence of hashes, in constant time from prefix sums modulo 2^64."""

    def __init__(self, h: np.ndarray, which: int = 0):
        n = len(h)
        power = np.full(n + 1, BASES[which], U)
        back = np.full(n + 1, INVERSES[which], U)
        power[0] = back[0] = _ONE
        self.back = np.cumprod(back, dtype=U)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(h * np.cumprod(power, dtype=U)[:n], dtype=U, out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def all(self, length: int) -> np.ndarray:
        """Every span of this length."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, U)
        return mix((self.sums[length:] - self.sums[:n]) * self.back[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    have = 1
    out = x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
