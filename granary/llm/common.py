"""What the operators of this subpackage share: shared-folder tables, Arrow batches, word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the word separators of most contracts here.
SPACE = b" \t\n\x0b\x0c\r"
#: Text bytes that one step of a Python worker handles at once (one longer text is a step of its own).
STEP_BYTES = 1 << 20
#: Rows of an Arrow batch: a worker holds one batch of texts at a time.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = BATCH_ROWS) -> None:
    """Keeps Arrow batches of texts small; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; a temporary one only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="granary-"))
    return sc.getCheckpointDir()


#: Paths of the tables that ``stored`` wrote and nothing deleted yet, each with its session.
_kept: dict[str, SparkSession] = {}


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    What reads the table decides when it can go (``forget``); what is left goes with the driver.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/granary-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept[path] = spark
    again = spark.read.schema(df.schema).parquet(path)
    again._granary_path = path
    return again


def forget(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_granary_path", None)
        if path:
            _delete(path)


def _delete(path: str) -> None:
    spark = _kept.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def kept() -> set[str]:
    """The tables there are now, for ``forget_since``."""
    return set(_kept)


def forget_since(before: set[str], *tables: DataFrame) -> None:
    """Deletes what was stored since then, but for ``tables``."""
    for path in set(_kept) - before - {x._granary_path for x in tables}:
        _delete(path)


@atexit.register
def _forget_all() -> None:
    for path in list(_kept):
        try:
            _delete(path)
        except Exception:  # the session is gone
            return


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that text operators need, whatever else the table holds; null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def texts_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()


def steps(texts: list[bytes], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of at most ``most`` bytes together, or a single text."""
    return steps_of([len(t) for t in texts], most)


def steps_of(sizes: list[int], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """The same for texts of known sizes."""
    at = size = 0
    for i, n in enumerate(sizes):
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(sizes):
        yield at, len(sizes)


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list<int64> column from all values in a row and the length of each list."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply): a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_ODD))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
#: Powers are made so many at a time: a worker that gets short steps holds short tables.
_POWERS = 1 << 16
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        out = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            x = np.full(-(-n // _POWERS) * _POWERS, base, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _powers[:] = out
    return _powers


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all white-space words of the texts, A-Z lower-cased, and the number of words of each text.

    A word's hash is a polynomial over a random table of its bytes, taken from prefix sums
    modulo 2^64 (the base is odd, so it has an inverse), then mixed. All of it is vectorised.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=sums[1:])
    words = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return words, np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths + 1)))))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct ``k``-word shingles as ascending 64-bit hashes; of fewer words, the whole sequence as one.

    Two different shingles of a pair of texts share a hash with a probability of about
    n * n / 2^64, n being the shingles of the pair.
    """
    words, counts = hashed_words(texts)
    salt = [pow(_ODD, 2 * i + 3, 1 << 64) for i in range(k)]
    whole = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        whole += words[i : i + len(whole)] * np.uint64(salt[i])
    whole = mixed(whole)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(whole[at : at + n - k + 1]))
        elif n:
            one = n + sum(int(words[at + i]) * salt[i] for i in range(n))
            out.append(mixed(mixed(np.array([one % 2**64], np.uint64))))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out
