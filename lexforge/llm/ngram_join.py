"""Operator 1: N-gram Jaccard join, size-aware, heavy and light.

A document's set holds its distinct five-word shingles (64-bit hashes).  Two sets of sizes s and t reach Jaccard 0.8
only if they share ceil(4 (s + t) / 9) shingles; so of each set, taken in one global order, s - ceil(0.8 s) + k first
shingles must share k with any partner's.  Light sets enumerate the pairs of that prefix with k = 2 (fixed-size
subsets); heavy sets put their prefix with k = 1 in inverted lists and scan them, and light sets that a heavy one may
be near do so, too.  The boundary between light and heavy is the size that makes enumerating and scanning together
cheapest, from how many sets of each size there are and how long the lists of their shingles are, which is measured.

The global order puts frequent shingles last.  Frequencies and list lengths are counted in sketches of fixed size over
all documents; they steer cost only, since any fixed order gives the same links.  Equal sets become one node first.

All pairs of a list are candidates where the list is short.  In a list that may be long (by the sketch) each node first
meets the list's hub only; what is linked by then is a cluster, and the pairs of a long list are then those of
different clusters, dealt in blocks over many tasks, so that a group of thousands of near copies never becomes all its
pairs and no task gets a whole list.  Candidates pass a bitmap bound that loses no link, and the rest are verified on
whole sets.  Nothing is capped, dropped or sampled.

Results: null or empty text, or white space only, gives n_shingles 0, linked with nothing.  A null id is linked with
nothing and has a null component.  Rows that share an id belong to one component; repeated rows give repeated rows.
An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components, look_up
from .textops import forget, free_name, mix, relieved, tidied, tidy, word_hashes, written

WORDS = 5
#: Counters of the sketch; its size does not depend on the input.
COUNTERS = 1 << 20
_SLICE = 1 << 15
_BINS = 1024
#: Postings that one group of buckets holds, about, and keys that a task packs at a time.
POSTINGS = 200_000
FLUSH = 250_000
#: A list is long if its counter holds so many postings more than most counters do.
LONG = 16
#: Long lists in which a node meets the hub: so many at most, those with the least keys, which copies have in common.
HUBS = 8
#: Nodes of a part of a long list; two parts meet in one task.
PART = 2_048
#: What one other entry of a list costs to scan, in keys that are enumerated: about a third of the entries have a
#: fitting size and become candidates, and a candidate, shared by its two ends, costs about 16 keys to deal and join.
SCAN = 16 / 3 / 2
#: Bits by which documents that are wanted again are found before they are dealt.
WANTED = 1 << 24
_NOWHERE = np.uint32(0xFFFFFFFF)
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that a set of n shares with any partner at Jaccard 0.8: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def pair_overlap(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """The least intersection for which 100 * intersection >= 80 * union."""
    return (4 * (a + b) + 8) // 9


def shingle_sets(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first document, sorted distinct shingles of each document)."""
    for first, words, bounds, _ in word_hashes(column):
        count = np.diff(bounds)
        size = len(words) - WORDS + 1
        whole = np.zeros(0, np.uint64)
        if size > 0:
            total = np.zeros(size, np.uint64)
            for k, f in enumerate(_FACTORS):
                total += (words[k : k + size] ^ np.uint64(k)) * f
            whole = mix(total)
        sets = []
        for k, n in enumerate(count.tolist()):
            a = bounds[k]
            if n >= WORDS:
                s = np.sort(whole[a : a + n - WORDS + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                sets.append(s[keep])
            elif n:
                total = np.array([n], np.uint64)
                for x in words[a : a + n]:
                    total = mix(total * _FACTORS[1] + x)
                sets.append(total)
            else:
                sets.append(np.zeros(0, np.uint64))
        yield first, sets


def signature(s: np.ndarray) -> np.uint64:
    """One number for a whole set."""
    if not len(s):
        return np.uint64(0)
    parts = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(5))), np.add.reduce(mix(s)), len(s)], np.uint64)
    return mix(np.add.reduce(parts * np.array(_FACTORS[:3]), keepdims=True))[0]


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the set's hashes in a power of two of at least twice as many cells."""
    cells = max(64, 1 << int(2 * len(s) - 1).bit_length())
    flips = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def differ_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference of two sets."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "little"), len(a)
    while size > len(b):
        size //= 2
        x = (x >> (8 * size)) ^ (x & ((1 << (8 * size)) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def size_bin(n: np.ndarray) -> np.ndarray:
    """Exact below 256, then 32 bins an octave."""
    n = np.asarray(n, np.int64)
    top = np.maximum(np.floor(np.log2(np.maximum(n, 1))).astype(np.int64), 8)
    return np.minimum(np.where(n < 256, n, 256 + (top - 8) * 32 + ((n >> np.maximum(top - 5, 0)) & 31)), _BINS - 1)


_KINDS = {2: np.uint16, 4: np.uint32, 8: np.uint64}
_COUNTS = "slice int, part int, width int, counts binary"


def _sliced(*arrays: np.ndarray) -> pa.RecordBatch:
    """Counts as rows of slices, in as few bytes a count as the largest needs."""
    part = TaskContext.get().partitionId() % 64 if TaskContext.get() else 0
    rows = []
    for x in arrays:
        for k in range(0, len(x), _SLICE):
            own = x[k : k + _SLICE]
            width = 2 if own.max() < 1 << 16 else 4 if own.max() < 1 << 32 else 8
            rows.append((len(rows), part, width, own.astype(_KINDS[width]).tobytes()))
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["slice", "part", "width", "counts"])


def _added(table: pa.Table) -> pa.Table:
    total: np.ndarray | None = None
    for width, raw in zip(table.column("width").to_pylist(), table.column("counts"), strict=True):
        now = np.frombuffer(raw.as_buffer(), _KINDS[width]).astype(np.uint64)
        total = now if total is None else total + now
    return pa.table({"slice": table.column("slice")[:1], "part": table.column("part")[:1], "width": pa.array([8], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' arrays of counts.  Slices are added up in two steps, so no group grows with the number of
    tasks beyond its square root's order, and the driver gets one array."""
    once = parts.groupBy("slice", "part").applyInArrow(_added, _COUNTS)
    found = {r["slice"]: np.frombuffer(r["counts"], np.uint64).astype(np.int64) for r in once.groupBy("slice").applyInArrow(_added, _COUNTS).collect()}
    return np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(size, np.int64)


@relieved
def profile(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """How often each counter of the sketch is hit, and documents by size_bin, over all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, sizes = np.zeros(COUNTERS, np.int64), np.zeros(_BINS, np.int64)
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0)):
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                np.add.at(sketch, (every & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                sizes += np.bincount(size_bin(np.array([len(s) for s in sets], np.int64)), minlength=_BINS)
        yield _sliced(sketch, sizes)

    both = _summed(docs.select(text_col).mapInArrow(tidied(counted), _COUNTS), COUNTERS + _BINS)
    return both[:COUNTERS], both[COUNTERS:]


def frequent(sketch: np.ndarray) -> np.ndarray:
    """0 for counters as full as most, else 1 and up, by octaves of what they hold beyond that."""
    middle = float(np.median(sketch))
    spread = 1.4826 * float(np.median(np.abs(sketch - middle)))
    over = np.maximum(sketch - middle, 1)
    return np.where(over > max(16.0, 5 * spread), 1 + np.log2(over), 0).astype(np.uint8)


def prefix_size(n: int) -> int:
    """Shingles that a set of n puts in inverted lists."""
    return n - int(least_overlap(n)) + 1


@relieved
def list_lengths(nodes: DataFrame) -> np.ndarray:
    """How many postings each counter of the sketch stands for: the length of its shingles' inverted lists together."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            every = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            np.add.at(counts, (every & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        yield _sliced(counts)

    return _summed(nodes.select("prefix").mapInArrow(tidied(counted), _COUNTS), COUNTERS)


def noise(counts: np.ndarray) -> tuple[float, float]:
    """What most counters hold, and how far they spread around it."""
    middle = float(np.median(counts))
    return middle, 1.4826 * float(np.median(np.abs(counts - middle)))


def long_lists(counts: np.ndarray) -> np.ndarray:
    """Whether the lists of a counter may be long."""
    middle, spread = noise(counts)
    return counts - middle > max(float(LONG), 5 * spread)


@relieved
def scan_costs(nodes: DataFrame, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each size below 256: sets, and other entries in the lists of their prefixes, as the counters tell them
    (without bias: what other shingles add to a counter on average is taken off).  In a long list a node meets the hub."""
    long = long_lists(counts)
    average = float(counts[~long].sum()) / max(int((~long).sum()), 1)
    sent = nodes.sparkSession.sparkContext.broadcast(np.where(long, 2 + average, counts).astype(np.float32))  # 4 MB

    def costed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, others = np.zeros(256), np.zeros(256)
        for batch in batches:
            for n, prefix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(prefix, np.uint64)[: prefix_size(n)]
                sets[n] += 1
                others[n] += float(sent.value[(own & np.uint64(COUNTERS - 1)).astype(np.int64)].sum()) - len(own) * (1 + average)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(sets), pa.array(others)], names=["size", "sets", "others"])

    sets, others = np.zeros(256), np.zeros(256)
    for r in nodes.filter("n < 256").select(F.col("n").cast("int"), "prefix").mapInArrow(costed, "size int, sets double, others double").groupBy("size").agg(F.sum("sets").alias("sets"), F.sum("others").alias("others")).collect():
        sets[r["size"]], others[r["size"]] = r["sets"], r["others"]
    return sets, np.maximum(others, 0)


def boundary(sets: np.ndarray, others: np.ndarray) -> int:
    """The largest light size: that for which the keys of light sets, the postings of heavy ones and of those that a
    heavy one may be near, and the entries that are scanned in lists cost least together."""
    size = np.arange(256)
    p = size - least_overlap(size) + 1
    light, heavy = sets * p * (p + 1) / 2, sets * p + SCAN * others
    total = [light[:s].sum() + light[s] + heavy[(5 * size >= 4 * s)].sum() for s in range(256)]
    return int(np.argmin(total))


def profiles(docs: DataFrame, sketch: np.ndarray, level: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, node, prefix, bits, shared) of every document: size, signature, first shingles in the order, bitmap,
    and how full its shingles' counters are on average."""
    sent = docs.sparkSession.sparkContext.broadcast((level, np.minimum(sketch, (1 << 32) - 1).astype(np.uint32)))  # 5 MB

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, full = sent.value
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1)):
                sizes, nodes, prefixes, bits, shared = [], [], [], [], []
                for s in sets:
                    n = len(s)
                    sizes.append(n)
                    nodes.append(signature(s))
                    if not n:
                        prefixes.append(b"")
                        bits.append(b"")
                        shared.append(0.0)
                        continue
                    counters = (s & np.uint64(COUNTERS - 1)).astype(np.int64)
                    shared.append(float(full[counters].mean()))
                    late = level[counters]
                    hot = np.flatnonzero(late)
                    if len(hot):
                        s = np.concatenate([s[late == 0], s[hot[np.lexsort((s[hot], late[hot]))]]])
                    prefixes.append(s[: prefix_size(n) + 1].tobytes())
                    bits.append(bitmap(s))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array(sizes, pa.int64()), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(prefixes, pa.binary()), pa.array(bits, pa.binary()), pa.array(shared, pa.float64())], names=["doc_id", "n", "node", "prefix", "bits", "shared"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("prefix", T.BinaryType()), T.StructField("bits", T.BinaryType()), T.StructField("shared", T.DoubleType())])
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(tidied(made), schema)


@dataclass
class Keys:
    """Keys of a set, their places, the two shingles before them, and whether their lists may be long.  A place of
    _NOWHERE and a shingle of 0 say nothing."""

    key: np.ndarray
    place: np.ndarray
    before: np.ndarray
    long: np.ndarray

    def only(self, chosen: np.ndarray) -> Keys:
        return Keys(self.key[chosen], self.place[chosen], self.before[chosen], self.long[chosen])


def keys_of(prefix: np.ndarray, n: int, small: int, long: np.ndarray) -> Keys:
    """Pairs of the longer prefix for light sets, single shingles for heavy ones and those that a heavy set may meet.
    The list of a pair may be long only if the lists of both its shingles may."""
    keys, places, before, may = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros((0, 2), np.uint64)], [np.zeros(0, bool)]
    of_one = long[(prefix & np.uint64(COUNTERS - 1)).astype(np.int64)]
    if n <= small and len(prefix) >= 2:
        i, j = np.triu_indices(len(prefix), 1)
        a, b = prefix[i], prefix[j]
        keys.append(mix(np.minimum(a, b) * np.uint64(3) + np.maximum(a, b) * np.uint64(7) + np.uint64(1)))
        places.append(np.full(len(i), _NOWHERE, np.uint32))
        before.append(np.zeros((len(i), 2), np.uint64))
        may.append(of_one[i] & of_one[j])
    if n > small or 5 * n >= 4 * small:
        p = prefix_size(n)
        keys.append(mix(prefix[:p] + np.uint64(2)))
        places.append(np.arange(p, dtype=np.uint32))
        last = np.zeros((p, 2), np.uint64)
        last[1:, 0], last[2:, 1] = prefix[: p - 1], prefix[: max(p - 2, 0)]
        before.append(last)
        may.append(of_one[:p])
    return Keys(np.concatenate(keys), np.concatenate(places), np.concatenate(before), np.concatenate(may))


def postings(nodes: DataFrame, small: int, long: Broadcast, buckets: int) -> DataFrame:
    """Postings of (node, n, prefix) in short lists, packed by bucket of the key: few large rows are dealt instead of one
    row for each posting."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[tuple[int, int]] = []
        held: list[Keys] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not heads:
                return
            key, place, before = (np.concatenate([getattr(k, name) for k in held]) for name in ("key", "place", "before"))
            owner = np.repeat(np.arange(len(heads), dtype=np.uint32), [len(k.key) for k in held])
            table = np.array(heads, np.int64)
            bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, place, before, owner, bucket = key[order].astype(np.uint32), place[order], before[order], owner[order], bucket[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            out: list[list[object]] = [[] for _ in range(7)]
            for a, b in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
                used, local = np.unique(owner[a:b], return_inverse=True)
                part = table[used]
                for column, value in zip(out, (int(bucket[a]), part[:, 0].tobytes(), part[:, 1].astype(np.uint32).tobytes(), key[a:b].tobytes(), local.astype(np.uint32).tobytes(), place[a:b].tobytes(), before[a:b].tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], names=FORM_NAMES)
            heads.clear(), held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for node, n, prefix in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    keys = keys_of(np.frombuffer(prefix, np.uint64), n, small, long.value)
                    keys = keys.only(~keys.long)
                    if len(keys.key):
                        heads.append((node, n))
                        held.append(keys)
                        count += len(keys.key)
                    if count > FLUSH:
                        yield from flush()
                        count = 0
        yield from flush()

    return nodes.select("node", "n", "prefix").mapInArrow(tidied(packed), FORM)


def long_postings(nodes: DataFrame, small: int, long: Broadcast) -> DataFrame:
    """(key, node, n, shared, place, b1, b2, meets) of the postings in lists that may be long, one row each; meets is
    true for those in which the node meets the hub."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [keys_of(np.frombuffer(prefix, np.uint64), n, small, long.value) for n, prefix in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True)]
                found = [k.only(k.long) for k in found]
                owner = pa.array(np.repeat(np.arange(part.num_rows), [len(k.key) for k in found]))
                if not len(owner):
                    continue
                key, place, before = (np.concatenate([getattr(k, name) for k in found]) for name in ("key", "place", "before"))
                meets = np.concatenate([k.key <= np.partition(k.key, HUBS - 1)[HUBS - 1] if len(k.key) > HUBS else np.ones(len(k.key), bool) for k in found])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(part.column(k).take(owner) for k in range(3)), pa.array(place.astype(np.int64)), *(pa.array(before[:, k].copy().view(np.int64)) for k in (0, 1)), pa.array(meets)], names=["key", "node", "n", "shared", "place", "b1", "b2", "meets"])

    return nodes.select("node", "n", "shared", "prefix").mapInArrow(tidied(listed), "key long, node long, n long, shared double, place long, b1 long, b2 long, meets boolean")


FORM = "bucket long, nodes binary, sizes binary, keys binary, owners binary, places binary, befores binary"
FORM_NAMES = ["bucket", "nodes", "sizes", "keys", "owners", "places", "befores"]
PAIRS = "a long, b long, na long, nb long"


def _may_link(n: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """False where sizes, or what is left of both sets from the shared shingle on, rule a link out."""
    need = pair_overlap(n[i], n[j])
    fits = np.minimum(n[i], n[j]) >= need
    a, b = place[i].astype(np.int64), place[j].astype(np.int64)
    left = np.minimum(n[i] - a, n[j] - b)
    return fits & ((a == int(_NOWHERE)) | (b == int(_NOWHERE)) | (left >= need))


def _crossed(key: np.ndarray, node: np.ndarray, n: np.ndarray, label: np.ndarray, place: np.ndarray, before: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
    """In each list (one key), candidates between any two nodes of different labels and, but for 0, different sides.

    Two nodes need to meet in the list of the first shingle of the order that they share; where one of the two shingles
    before the list's is the same in both, they share an earlier one, and the pair is left to that one's list."""
    order = np.lexsort((n, label, key))
    key, node, n, label, place, before, side = (x[order] for x in (key, node, n, label, place, before, side))
    if not len(key):
        return
    new_key = np.append(True, key[1:] != key[:-1])
    new_run = new_key | np.append(True, label[1:] != label[:-1])
    at = np.arange(len(key))
    key_ends = np.append(np.flatnonzero(new_key)[1:], len(key))[np.cumsum(new_key) - 1]
    run_ends = np.append(np.flatnonzero(new_run)[1:], len(key))[np.cumsum(new_run) - 1]
    count = key_ends - run_ends
    live = np.flatnonzero(count)
    step = 0
    while step < len(live):  # a quarter of a million pairs at a time, to bound memory
        reach = np.cumsum(count[live[step : step + 250_000]])
        end = step + max(1, int(np.searchsorted(reach, 250_000, side="right")))
        part = live[step:end]
        i = np.repeat(at[part], count[part])
        first = np.cumsum(count[part]) - count[part]
        j = np.repeat(run_ends[part] - first, count[part]) + np.arange(len(i))
        good = (node[i] != node[j]) & ((side[i] == 0) | (side[i] != side[j])) & _may_link(n, place, i, j)
        i, j = i[good], j[good]
        earlier = np.zeros(len(i), bool)
        for x in (0, 1):
            for y in (0, 1):
                earlier |= (before[i, x] == before[j, y]) & (before[i, x] != 0)
        i, j = i[~earlier], j[~earlier]
        if len(i):
            swap = node[i] > node[j]
            a, b = np.where(swap, j, i), np.where(swap, i, j)
            found = np.unique(np.stack([node[a], node[b], n[a], n[b]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k].copy()) for k in range(4)], names=["a", "b", "na", "nb"])
        step = end


def short_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of a bucket of packed short lists: all pairs of each list."""
    columns: list[list[np.ndarray]] = [[] for _ in range(5)]
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: np.frombuffer(batch.column(name)[k].as_buffer(), kind) for name, kind in (("nodes", np.int64), ("sizes", np.uint32), ("keys", np.uint32), ("owners", np.uint32), ("places", np.uint32), ("befores", np.uint64))}
            values = (row["keys"].copy(), row["nodes"][row["owners"]], row["sizes"][row["owners"]].astype(np.int64), row["places"].copy(), row["befores"].reshape(-1, 2).copy())
            for column, value in zip(columns, values, strict=True):
                column.append(value)
    key, node, n, place, before = (np.concatenate(c) for c in columns)
    columns.clear()
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    order = order[np.append(same, False) | np.append(False, same)]  # lists of two nodes or more
    yield from _crossed(key[order], node[order], n[order], node[order], place[order], before[order], np.zeros(len(order), np.int8))
    tidy()


def long_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of a bucket of blocks of long lists: all pairs of different clusters."""
    table = pa.Table.from_batches(batches)
    key, node, n, label, place, side = (table.column(c).to_numpy() for c in ("cell", "node", "n", "label", "place", "side"))
    before = np.stack([table.column(c).to_numpy() for c in ("b1", "b2")], axis=1)
    del table
    yield from _crossed(key, node, n, label, place, before, side)
    tidy()


def stars(listed: DataFrame) -> DataFrame:
    """Candidates between the nodes of a long list and its hub, one of like size, for two overlapping divisions of sizes;
    hubs are found by partial aggregation.  The hub is the node whose shingles most others have, as the text has from
    which the others were made."""
    classes = F.array(*[F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + shift) * 2 + k for k, shift in enumerate((0.0, 0.5))])
    keyed = listed.filter("meets").select("key", "node", "n", "shared", F.explode(classes).alias("size"))
    hubs = keyed.groupBy("key", "size").agg(F.min(F.struct((-F.col("shared")).alias("order"), "node", "n")).alias("hub"))
    pairs = keyed.join(hubs, ["key", "size"]).filter(F.col("node") != F.col("hub.node"))
    return pairs.select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"))


def crossings(listed: DataFrame, clusters: DataFrame) -> DataFrame:
    """Candidates between nodes of different clusters in long lists.  Lists of one cluster go; the others are dealt into
    parts, and each pair of parts is a block of its own."""
    labelled = listed.drop("shared", "meets").join(clusters, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    spans = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / PART).alias("parts")).filter("low < high").select("key", "parts")
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    dealt = labelled.join(spans, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = dealt.withColumn("cell", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).withColumn("side", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2))
    cells = written(cells.select("cell", "node", "n", "label", "place", "b1", "b2", "side"), "blocks")
    buckets = max(1, -(-cells.count() // POSTINGS))
    return cells.groupBy(F.pmod(F.xxhash64("cell"), F.lit(buckets)).alias("bucket")).applyInArrow(long_pairs, PAIRS)


def _within_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [differ_at_least(x, y) <= s + t - 2 * pair_overlap(s, t) for x, y, s, t in zip(batch.column("ba").to_pylist(), batch.column("bb").to_pylist(), batch.column("na").to_pylist(), batch.column("nb").to_pylist(), strict=True)]
        yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))


#: Nodes that a task remembers as joined while it verifies links.
JOINED = 100_000


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sets, but for those whose ends this task has joined already."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        keep = []
        for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("sa"), batch.column("sb"), strict=True):
            if len(parent) > JOINED:
                parent.clear()
            a, b = root(a), root(b)
            if a == b:
                keep.append(False)
                continue
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(s) > len(t):
                s, t = t, s
            shared = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
            keep.append(100 * shared >= 80 * (len(s) + len(t) - shared))
            if keep[-1]:
                parent[a] = b
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in shingle_sets(batch.column(1)):
            nodes = np.array([signature(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array(nodes), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "node", "shingles"])


def among(rows: DataFrame, col: str, wanted: DataFrame, name: str) -> DataFrame:
    """The rows whose value is among the wanted ones, and few others: by a bitmap of WANTED bits, which is the only thing
    sent to all.  It spares the shuffle of rows that the join which must follow would drop."""
    spot = lambda x: (F.pmod(F.xxhash64(x), F.lit(WANTED)) + 1).cast("long")
    marks = wanted.select(spot(name).alias("_at")).groupBy(F.call_function("bitmap_bucket_number", F.col("_at")).alias("_bucket"))
    marks = marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    bit = F.bitmap_bit_position(spot(col))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.join(F.broadcast(marks), F.call_function("bitmap_bucket_number", spot(col)) == F.col("_bucket"))
    return marked.filter(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


def links(candidates: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b) of the candidates that reach the threshold: bitmaps first, whole sets of what is left."""
    bits = nodes.select("node", "bits")
    joined = candidates.distinct().join(bits.select(F.col("node").alias("a"), F.col("bits").alias("ba")), "a").join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bb")), "b")
    near = written(joined.mapInArrow(tidied(_within_bounds), PAIRS), "near")
    wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    shown = nodes.join(wanted, "node", "left_semi").select(F.col("doc_id").alias("want_id"), F.col("node").alias("want"))
    shown = written(shown, "shown")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = among(texts, "doc_id", shown, "want_id").join(shown.select(F.col("want_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("node", T.LongType()), T.StructField("shingles", T.BinaryType())])
    sets = texts.mapInArrow(tidied(_sets), schema).join(shown, (F.col("doc_id") == F.col("want_id")) & (F.col("node") == F.col("want")), "left_semi").dropDuplicates(["node"]).select("node", "shingles")
    sets = written(sets, "sets")
    full = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    linked = written(full.mapInArrow(tidied(_verified), "a long, b long"), "linked")
    forget(near), forget(sets), forget(shown)
    return linked


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, small: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row of docs."""
    sketch, _ = profile(docs, text_col)
    level = frequent(sketch)
    base = written(profiles(docs, sketch, level, id_col, text_col), "profiles")
    # one row for each distinct set, shown by the smallest id that has it
    shown = base.filter("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "prefix", "bits", "shared")])
    nodes = written(shown, "nodes")
    wide, base = base, written(base.select("doc_id", "n", "node"), "documents")
    forget(wide)
    counts = list_lengths(nodes)
    if small is None:
        small = boundary(*scan_costs(nodes, counts))
    long = docs.sparkSession.sparkContext.broadcast(long_lists(counts))  # 1 MB
    buckets = buckets or max(1, -(-int(counts.sum()) // POSTINGS))
    short = postings(nodes, small, long, buckets).groupBy("bucket").applyInArrow(short_pairs, PAIRS)
    listed = written(long_postings(nodes, small, long), "long")
    first = links(short.unionByName(stars(listed)), nodes, docs, id_col, text_col)
    clusters = written(components(first), "clusters")
    second = links(crossings(listed, clusters), nodes, docs, id_col, text_col)
    owners = written(nodes.select("node", "doc_id", "copies"), "owners")
    forget(nodes), forget(listed), forget(first)
    # an id with several rows joins their sets, and a row without a set belongs to those that its id has besides
    own = F.when(F.col("n") > 0, F.col("node"))
    ids = base.filter("doc_id is not null").groupBy("doc_id").agg(F.min(own).alias("a"), F.max(own).alias("b"), F.min("n").alias("least"))
    shared = written(ids.filter("a < b or least = 0 and a is not null").select("doc_id", "a", "b"), "shared")
    twice = base.filter("n > 0").join(shared.filter("a < b").select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))
    more = written(second.unionByName(twice), "more")
    found = clusters if more.isEmpty() else components(clusters.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    grouped = owners.join(found, "node", "left").select("node", "copies", "doc_id", F.coalesce("component", "node").alias("group"))
    least = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("weight"))
    named = written(look_up(grouped.drop("doc_id"), least, "group", "weight", owners.count()).drop("group"), "named")
    empty = base.filter("n = 0 and doc_id is not null").join(shared.select("doc_id", "a"), "doc_id", "left").select("doc_id", "n", F.col("a").alias("node"))
    linked = base.filter("n > 0 and doc_id is not null").unionByName(empty.filter("node is not null"))
    out = look_up(linked, named, "node", "copies", base.count()).select("doc_id", "n", "component_id")
    alone = empty.filter("node is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    nameless = base.filter("doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).unionByName(nameless).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is their component's smallest, with all their columns; of repeated rows with one id,
    the first in order of text stays.  Rows with a null id or an empty set stay."""
    gone_col, many, turn = (free_name(docs.columns, x) for x in ("_gone", "_many", "_turn"))
    found = jaccard_join(docs, id_col=id_col, text_col=text_col).filter(F.col(id_col).isNotNull())
    gone = found.filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(gone_col)).distinct()
    left = docs.join(gone, F.col(id_col) == F.col(gone_col), "left_anti")
    repeated = found.groupBy(F.col(id_col).alias(many)).agg(F.count("*").alias("n")).filter("n > 1").select(many)
    single = left.join(repeated, F.col(id_col) == F.col(many), "left_anti")
    several = left.join(repeated, F.col(id_col) == F.col(many), "left_semi")
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))
    return single.unionByName(several.withColumn(turn, first).filter(F.col(turn) == 1).drop(turn))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB SQL for op1_ngram_join, by an inverted list of all shingles.
OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS x FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 5 THEN [array_to_string(x, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' ')))) END AS g FROM w
), h AS (SELECT doc_id, len(g) AS n, md5(array_to_string(g, '|')) AS k, g FROM s
), d AS (SELECT k, min(doc_id) AS doc_id, any_value(n) AS n, any_value(g) AS g FROM h WHERE n > 0 GROUP BY k
), p AS (SELECT doc_id, n, unnest(g) AS t FROM d
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.t = b.t AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT h.doc_id, h.n::BIGINT AS n_shingles, coalesce(c.component_id, h.doc_id)::BIGINT AS component_id
FROM h LEFT JOIN d ON d.k = h.k AND h.n > 0 LEFT JOIN c ON c.a = d.doc_id
"""
