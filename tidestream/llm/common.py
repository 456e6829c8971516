"""Shared pieces: checkpoints, size-checked joins, and vectorised word and window kernels over Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestream.sources.checkpoints import checkpointed, folder  # noqa: F401  (used as common.checkpointed, common.folder)

#: A word, as a Java regular expression: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Rows up to which the small side of a join is broadcast; above, the join shuffles with salt.
BROADCAST_ROWS = 20_000
#: Salts that spread a hot key of a shuffled join.
SALTS = 32
#: Characters of text (roughly) that one kernel call takes at once, so that its temporaries stay bounded.
CHUNK_BYTES = 1 << 19


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blank_split(text: Column) -> Column:
    """text, not null, split at every blank; single-character replaces and splits cost less than regular expressions."""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.split(text, " ", -1)


def word_array(text: Column) -> Column:
    """The words of a text that isn't null."""
    return F.array_remove(blank_split(text), "")


def unclashing(keys: DataFrame, key: str, docs: DataFrame) -> DataFrame:
    """keys with its column under a name that docs has none of."""
    name = f"__{key}"
    while name in docs.columns:
        name += "_"
    return keys.select(F.col(key).alias(name))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def left_join_small(big: DataFrame, small: DataFrame, key: str, salt: Column) -> DataFrame:
    """big left join small on key, null-safe, small having one row per key. small is broadcast
    if it has at most BROADCAST_ROWS rows; otherwise both sides are shuffled by key and a salt taken from big,
    so that a key with a third of the rows spreads over SALTS tasks. small should be checkpointed: it is counted."""
    right = small.withColumnRenamed(key, "__key")
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(right), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    right = right.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = big.withColumn("__salt_l", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    on = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__salt_l") == F.col("__salt_r"))
    return left.join(right, on, "left").drop("__key", "__salt_l", "__salt_r")


# --- kernels -------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240117))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[_SPACE] = 0
_STEP = 1 << 16
_POWER = np.cumprod(np.full(_STEP, 0x9E3779B97F4A7C13, np.uint64))
#: Odd multipliers of the positions in a window.
ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and the offset of each row's text and of the end; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = CHUNK_BYTES) -> list[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer row stands alone and whole."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        out.append((i, min(j, n)))
        i = out[-1][1]
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of the rows: first byte, end, row, and a 64-bit hash. lower: A-Z count as a-z."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none, np.zeros(0, np.uint64)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64)
    at = np.arange(len(data)) - np.repeat(np.concatenate(([0], start)), np.diff(np.concatenate(([0], start, [len(data)]))))
    value = _BYTE[data] * _POWER[at & (_STEP - 1)]
    code = mix(np.add.reduceat(value, start) + (end - start).astype(np.uint64) * ODD[0])
    return start, end, np.searchsorted(offsets, start, "right") - 1, code


def window_codes(code: np.ndarray, size: int, shift: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of `size` words, in order of its first word."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += code[k : k + n] * ODD[shift + k]
    return mix(total)
