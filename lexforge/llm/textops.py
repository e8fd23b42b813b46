"""Vectorised word hashing over Arrow text columns, and small session helpers.

Words are maximal runs of bytes outside ``0x20, 0x09-0x0D``; A-Z is lower-cased.
Every word of every text is read: texts longer than a segment are cut at white
space, so memory is bounded by ``SEGMENT`` bytes (or one word, if longer).
"""

from __future__ import annotations

import ctypes
import ctypes.util
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: list[np.ndarray] = []

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of uint64."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SEGMENT + 65536)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        out = []
        for base in (_BASE, inverse):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and n + 1 offsets, without a copy of the bytes where it has one chunk; null counts as
    empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.cast(pa.large_string()).chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    kind = np.int32 if column.type == pa.string() else np.int64
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if column.null_count:  # what stands under a null is left out
        sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offs))
        if sizes.sum() != offs[-1] - offs[0]:
            return text_buffer(pc.fill_null(column, ""))
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _segments(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first document, end document, first byte, end byte) of pieces of about SEGMENT bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + SEGMENT, side="right")) - 1
        if j > i:
            yield i, j, int(offs[i]), int(offs[j])
            i = j
            continue
        a, end = int(offs[i]), int(offs[i + 1])
        while a < end:
            b = min(a + SEGMENT, end)
            while b < end:  # back to white space, or on to it if a word is longer
                gaps = np.flatnonzero(_SPACE[raw[a:b]])
                if len(gaps):
                    b = a + int(gaps[-1]) + 1
                    break
                b = min(b + SEGMENT, end)
            yield i, i + 1, a, b
            a = b
        i += 1


def _hash_segment(data: np.ndarray, starts_at: np.ndarray, parts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start and hash of every word, and for each k of parts a hash of its first k bytes, of its last -k bytes
    for a negative k, or for 0 the number of its A-Z."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), [np.zeros(0, np.uint64) for _ in parts]
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[starts_at] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_LOWER[data] * power[:n], out=total[1:])
    back = inverse[starts]
    hashes = mix((total[ends] - total[starts]) * back)
    found = []
    for k in parts:
        if k > 0:
            found.append(mix((total[np.minimum(starts + k, ends)] - total[starts]) * back + np.uint64(k)))
        elif k < 0:
            at = np.maximum(ends + k, starts)
            found.append(mix((total[ends] - total[at]) * inverse[at] + np.uint64(1000 - k)))
        else:
            capitals = np.cumsum(np.append(np.int32(0), (data >= 65) & (data <= 90)), dtype=np.int32)
            found.append((capitals[ends] - capitals[starts]).astype(np.uint64))
    return starts, hashes, found


def word_hashes(column: pa.Array | pa.ChunkedArray, parts: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(first document, word hashes, offsets by document, what parts asks for) for runs of whole documents."""
    raw, offs = text_buffer(column)
    held: list[tuple[np.ndarray, list[np.ndarray]]] = []
    for i, j, a, b in _segments(raw, offs):
        inner = offs[i:j] - a if j > i + 1 or a == offs[i] else np.zeros(0, np.int64)
        starts, hashes, heads = _hash_segment(raw[a:b], np.clip(inner, 0, b - a), parts)
        if j == i + 1 and (b < offs[j] or held):
            held.append((hashes, heads))
            if b < offs[j]:
                continue
            hashes = np.concatenate([h for h, _ in held])
            heads = [np.concatenate([x[k] for _, x in held]) for k in range(len(parts))]
            held = []
            yield i, hashes, np.array([0, len(hashes)]), heads
            continue
        bounds = np.searchsorted(starts, np.append(offs[i:j], offs[j]) - a, side="left")
        yield i, hashes, bounds, heads


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one is made only where it is unset and all runs on one machine."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        given = getattr(spark, "_lexforge_shared", None) or tempfile.mkdtemp(prefix="lexforge-")
        spark._lexforge_shared = given
    return given.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and outlives executors.  What forget() does not
    delete before goes when the session's driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes what written() has made, once nothing reads it."""
    jvm = df.sparkSession._jvm
    for f in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(ctypes.util.find_library("c")).malloc_trim
    except (AttributeError, OSError, TypeError):  # another C library
        return None


def tidy() -> None:
    """Gives memory that nothing uses back to the system: Python workers live on, and what one stage had freed would
    still count when the next one runs."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


#: How to give up what a worker remembers from partition to partition, by the name of what remembers it.
REMEMBERED: dict[str, Callable[[], None]] = {}


def tidied(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, with tidy() after the last batch of a partition; what the worker remembers for other functions
    than f is given up before the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = [give_up for name, give_up in REMEMBERED.items() if name != keeps]
        for give_up in others:
            give_up()
        if others:
            tidy()
        try:
            yield from f(batches)
        finally:
            tidy()

    return run


def relieved(f: Callable[..., Any]) -> Callable[..., Any]:
    """f for the driver, with tidy() after what it held is gone."""

    @wraps(f)
    def run(*given: Any, **named: Any) -> Any:
        out = f(*given, **named)
        tidy()
        return out

    return run


def free_name(columns: list[str], wanted: str) -> str:
    """wanted, with underscores until no column has the name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
