"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch. Texts may be long, so batches are kept small.
BATCH_ROWS, BATCH_BYTES = 500, 33_554_432


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes. A smaller bound of the session's own stays; a larger one is lowered for good, as
    the plans made here read it only when they run."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one in local mode, where all tasks share
    the machine, and an error on a cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(f"file://{tempfile.mkdtemp(prefix='orbitframe-')}")
    return _OWN_FOLDER[0]


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: the lineage ends here, on storage that
    outlives an executor. ``options``: those of Spark's writer."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(id_col, text_col):
    """128 bits, as hex digits, of a document row's id and text, by which the rows of one id are told apart."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.when(F.col(text_col).isNull(), "-").otherwise(F.concat(F.lit(":"), F.col(text_col)))))


#: Bits of a table of keys for each key, and of any table; bits that one row sends to the driver.
KEY_BITS, TABLE_BITS, CHUNK_BITS = 16, 1 << 24, 1 << 15


def maybe_in(keys: DataFrame, key: str):
    """A function of a column that is true for all values of ``keys[key]`` and, as long as these are fewer than the bits of a bounded table, false for
    most others: what it rules out needs no join. The table is made in chunks by tasks, so that the driver gets 2 MB at most."""
    count = keys.count()
    size = min(TABLE_BITS, max(CHUNK_BITS, 1 << (KEY_BITS * max(1, count) - 1).bit_length()))

    def chunk(number, frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(CHUNK_BITS, bool)
        bits[frame["bit"].to_numpy(np.int64)] = True
        return pd.DataFrame({"chunk": [int(number[0])], "bits": [np.packbits(bits).tobytes()]})

    packed = np.zeros(size // 8, np.uint8)
    if count:
        place = keys.select(F.pmod(F.xxhash64(key), F.lit(size)).alias("place")).distinct()
        chunks = place.select(F.expr(f"place div {CHUNK_BITS}").alias("chunk"), (F.col("place") % CHUNK_BITS).alias("bit")).groupBy("chunk").applyInPandas(chunk, "chunk long, bits binary")
        for row in chunks.collect():
            packed[row.chunk * CHUNK_BITS // 8 : (row.chunk + 1) * CHUNK_BITS // 8] = np.frombuffer(row.bits, np.uint8)

    @F.pandas_udf("boolean")
    def maybe(places: pd.Series) -> pd.Series:
        at = places.to_numpy(np.int64)
        return pd.Series((packed[at >> 3] >> (7 - (at & 7))) & 1 == 1)

    return lambda column: maybe(F.pmod(F.xxhash64(column), F.lit(size)))


def map_texts(docs: DataFrame, run, schema: str, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``mapInPandas`` over ``(doc_id, text, ...)`` that gives ``doc_id`` and the columns of ``schema``. Inside, a null id is zero
    and ``no_id``, so that ids never become floats there; ``run`` passes both columns on. ``more``: further columns."""
    number = F.col(id_col).cast("long")
    source = docs.select(F.coalesce(number, F.lit(0).cast("long")).alias("doc_id"), number.isNull().alias("no_id"), F.col(text_col).alias("text"), *[c.alias(n) for n, c in more.items()])
    return with_null_ids(source.mapInPandas(run, f"doc_id long, no_id boolean, {schema}"))


def with_null_ids(df: DataFrame) -> DataFrame:
    """``doc_id`` null again where ``no_id`` says so."""
    return df.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def id_crc(id_col: str = "doc_id"):
    """The CRC-32 of an id in decimal; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def held_out(id_col: str = "doc_id", one_of: int = 5):
    """Whether a row is kept from the fit; a row of null id isn't held out, though it is never fitted to."""
    return F.coalesce((id_crc(id_col) % one_of) == 0, F.lit(False))


# ---------------------------------------------------------------- words as arrays

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the SplitMix64 generator, a bijection on 64-bit integers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = _splitmix(np.arange(1, 257, dtype=np.uint64))
_FACTORS = _splitmix(np.arange(1000, 1000 + 4096, dtype=np.uint64)) | np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.zeros(0, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.full(max(n, 256) - 1, _BASE)]).cumprod(dtype=np.uint64)
    return _POWERS


#: glibc's numbers of the settings for mmap and trimming, and the size from which freed memory leaves the process.
_MMAP_THRESHOLD, _TRIM_THRESHOLD, RETURNED_BYTES = -3, -1, 4_194_304


@functools.cache
def return_memory() -> None:
    """Freed arrays of 4 MB or more go back to the system at once. Left alone, glibc raises that bound to 32 MB as it sees larger
    arrays, and each worker keeps what its largest task took, through all later stages. Other C libraries stay as they are."""
    try:
        setting = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    setting(_MMAP_THRESHOLD, RETURNED_BYTES)
    setting(_TRIM_THRESHOLD, RETURNED_BYTES)


#: Words that are hashed at once, so that the numbers of single bytes stay few.
HASHED_WORDS = 65_536


class Words:
    """The words of several texts: ``hash`` (64 bits each) and ``doc`` (index of the text), in order."""

    def __init__(self, texts: list[bytes]):
        return_memory()
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        inside = ~_SPACE[buf]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        size = ends - starts
        ends_of_texts = np.cumsum(lengths + 1)
        self.doc = np.searchsorted(ends_of_texts, starts, side="right")
        #: The byte of its text at which a word starts.
        self.place = starts - (ends_of_texts - lengths - 1)[self.doc]
        self.hash = np.zeros(len(starts), np.uint64)
        for a in range(0, len(starts), HASHED_WORDS):
            own = size[a : a + HASHED_WORDS]
            held = buf[starts[a] : ends[a + len(own) - 1]]
            first = np.concatenate([[0], np.cumsum(own)[:-1]])
            place = np.arange(own.sum()) - np.repeat(first, own)
            values = _BYTE_CODE[held[~_SPACE[held]]] * _powers(int(own.max()))[place]
            self.hash[a : a + len(own)] = _splitmix(np.add.reduceat(values, first) + own.astype(np.uint64))

    def runs(self, k: int) -> np.ndarray:
        """A 64-bit hash of the k words from each word on; defined where ``k`` words are left in the batch."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out += self.hash[i : i + n] * _FACTORS[i]
        return _splitmix(out)

    def windows(self, k: int) -> np.ndarray:
        """Where k words of one text start."""
        n = len(self.hash) - k + 1
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :]) if n > 0 else np.zeros(0, np.int64)


def text_batches(rows, text_bytes: int = 8_000_000):
    """Regroup pandas batches so that each holds about ``text_bytes`` of text; a longer text stands alone."""
    for frame in rows:
        size, begin = 0, 0
        lengths = frame["text"].str.len().fillna(0).to_numpy(dtype="int64") if len(frame) else []
        for i, n in enumerate(lengths):
            if size and size + n > text_bytes:
                yield frame.iloc[begin:i]
                size, begin = 0, i
            size += n
        if begin < len(frame):
            yield frame.iloc[begin:]


def encoded(texts) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in texts]
