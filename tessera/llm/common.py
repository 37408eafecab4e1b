"""What several corpus operators share: words, hashes, and tables written to the shared folder."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space and U+0009..U+000D (the ASCII white space of bytes.split).
SEPARATORS = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; set here only where it is unset (local tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = spark.conf.get("spark.tessera.scratch", None)
    if not path:
        path = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.tessera.scratch", path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to a new parquet table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() made, once all that reads it has been stored."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for the row, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def lower_ascii_bytes(text: bytes) -> bytes:
    return text.lower()  # bytes.lower touches A-Z only


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null. Separators at the ends are cut first, so split makes no empty word but for an empty text."""
    cut = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, SEPARATORS))


def free_names(taken, *wanted: str) -> list[str]:
    """Column names for private use that no column in taken has, in any case of letters."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


# --- 64-bit hashes of words and of runs of words -------------------------------------------------------
# Each step mixes all bits before the next value comes in, so sums of values that cancel out have no say; two families give 128 bits.

_PIECE = 1 << 18
_SEED = (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)
_FACTOR = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LONG = 256  # longer words go through blake2b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def absorb(state: np.ndarray, value: np.ndarray, which: int = 0) -> np.ndarray:
    """The hash of what state stands for, followed by value."""
    return mix(state * np.uint64(_FACTOR[which]) + value)


def windows_hash(h: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of width values of h, by doubling; runs of the rest overlap what they complete."""
    out, size = h, 1
    while size < width and len(out):
        step = min(size, width - size)
        out = absorb(mix(out[:-step] + np.uint64(size)), out[step:], which) if len(out) > step else out[:0]
        size += step
    return out


def run_hash(h: np.ndarray, which: int = 0) -> int:
    """One hash of all values of h, in order."""
    state = np.array([_SEED[which] + len(h)], np.uint64)
    for k in range(len(h)):
        state = absorb(state, h[k : k + 1], which)
    return int(state[0])


_IS_SEP = np.zeros(256, bool)
_IS_SEP[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words in a UTF-8 buffer."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_IS_SEP[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes at a time, for all words that are so long."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    out = np.empty(len(starts), np.uint64)
    for lo in range(0, len(starts), _PIECE):
        at, left = starts[lo : lo + _PIECE], ends[lo : lo + _PIECE] - starts[lo : lo + _PIECE]
        state = mix(left.astype(np.uint64) + np.uint64(_SEED[which]))
        longer = np.flatnonzero(left > _LONG)
        live, done = np.flatnonzero(left <= _LONG), 0
        while len(live):
            state[live] = absorb(state[live], eight[at[live] + done] & mask[np.minimum(left[live] - done, 8)], which)
            done += 8
            live = live[left[live] > done]
        for i in longer.tolist():
            word = data[at[i] : at[i] + left[i]].tobytes()
            state[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, person=bytes([which])).digest(), "little")
        out[lo : lo + _PIECE] = state
    return out


def text_buffer(texts) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array with a line feed after each text, and the offset at which each text starts (n + 1 of them)."""
    parts = [b"" if t is None else t for t in texts.cast("binary").to_pylist()]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), offsets
