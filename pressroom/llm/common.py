"""What the operators share: word rules, shared-folder tables, checked broadcasts, hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: the ASCII blank and tab to carriage return. bytes.split() splits at these six and no others.
BLANKS = " \t\n\x0b\x0c\r"
#: The same separators for Java's regular expressions.
JAVA_BLANKS = r"[\x20\x09-\x0D]+"
#: Rows up to which a relation of short rows may be broadcast (at 100 bytes a row, 20 MB).
BROADCAST_ROWS = 200_000

_A_TO_Z = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_ascii(raw: bytes) -> bytes:
    return raw.translate(_A_TO_Z)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). Where that is unset a local folder serves a local session; a cluster has to set it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pressroom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, old: list[str] | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it again: lineage ends there, and lost executors don't lose it. old: gets the path, for `remove`."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    if old is not None:
        old.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing reads any longer, wherever the shared folder is, and empties the list."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def small_or_same(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has `rows` rows at most, else df as it is, to be joined by shuffle. df should be materialized."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def word_array(text: str | Column) -> Column:
    """Native words of a text, lower-cased A-Z; null and blank texts give an empty array."""
    col = F.col(text) if isinstance(text, str) else text
    low = F.translate(F.coalesce(col, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, JAVA_BLANKS), lambda w: w != "")


def text_key(text: str | Column = "text") -> Column:
    """64 bits of a text; with doc_id beside it, a document's key."""
    col = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(col, F.lit("")), col.isNull())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words, remembered for up to `bound` words."""

    def __init__(self, bound: int = 250_000):
        self.seen: dict[bytes, int] = {}
        self.bound = bound

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        if len(self.seen) > self.bound:
            self.seen.clear()
        seen, get = self.seen, self.seen.get
        out = [get(w) for w in words]
        if None in out:
            h = xxhash.xxh3_64_intdigest
            for i, x in enumerate(out):
                if x is None:
                    w = words[i]
                    out[i] = seen[w] = h(w)
        return np.array(out, dtype=np.uint64)


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words make one shingle of the whole sequence, none an empty set."""
    if len(hashes) == 0:
        return hashes
    m = min(n, len(hashes))
    acc = np.full(len(hashes) - m + 1, np.uint64(m), dtype=np.uint64)
    for i in range(m):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - m + 1 + i])
    return np.unique(acc)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
