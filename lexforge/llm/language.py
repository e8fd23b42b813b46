"""Operator 7: language identification by cross-parsing entropy.

For every language a suffix automaton of labelled texts, each learned whole, is laid out as a dense table over the
letters of those texts, or, when dense tables get too large, as a sorted list of its transitions.  A text is cut greedily
into the longest phrases that occur in a language's labelled text; the language that needs the fewest phrases, each
counted as the logarithm of that text's length and divided by the letters read, wins.  Every character of every text is
read, and a phrase goes on over whatever blocks and pieces the text is read in: many texts are parsed side by side, and
the last, longest ones one by one from where they stand.

Labelled texts are a bounded sample of rows: of each language at most ROWS that are not held out, of those with at most
LONGEST characters, chosen by a hash of id and text; a language without any so short is learned from its shortest one.

Letters are lower-cased and every run of anything else counts as one space.  Text that is null or has no letter is `und`
with score 0.  Ties go to the language first in order.  With no labelled text at all every text is `und`.  Rows with
null ids or languages are predicted but not learned; repeated rows are predicted each; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import held_out, relieved, text_buffer, tidied

#: Labelled documents learned for each language, at most.
ROWS = 16
#: Characters of a document that is learned, at most, where the language has one so short.
LONGEST = 8_192
#: Cells of all dense tables together, at most.
CELLS = 16_000_000
#: Bytes of text whose letters are looked up together; longer texts are read piece by piece.
PIECE = 1 << 20
#: Characters that all texts advance before those at their end are left out, and texts for which that is worth while.
BLOCK = 256
LANES = 48
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter and its lower-case form."""
    letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            letter[c] = True
            low = s.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return letter, lower


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions by class of each state of the suffix automaton of a sequence of classes; row 0 is the start."""
    size = 2 * len(text) + 2
    length, link, last, used = [0] * size, [-1] * size, 0, 1
    rows: list[dict[int, int]] = [{}]
    for c in text.tolist():
        new, used = used, used + 1
        rows.append({})
        length[new] = length[last] + 1
        p = last
        while p >= 0 and c not in rows[p]:
            rows[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = rows[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy, used = used, used + 1
                rows.append(dict(rows[q]))
                length[copy], link[copy] = length[p] + 1, link[q]
                while p >= 0 and rows[p].get(c) == q:
                    rows[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return rows


def dense(rows: list[dict[int, int]], width: int) -> np.ndarray:
    """Transitions as a table of states and classes, -1 for none."""
    step = np.full((len(rows), width), -1, dtype=np.int32)
    for k, row in enumerate(rows):
        for c, to in row.items():
            step[k, c] = to
    return step


class Dense:
    """A flat table of where each (state, class) leads, states multiplied by the width; where a phrase begins, ~ of the
    state that it begins with (negative).  State 0 is before any phrase and after a character that occurs nowhere."""

    kind = np.int32

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    def advance(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Moves the states on by a class each; -1 where a phrase begins, else 0."""
        state += c
        self.table.take(state, out=state, mode="clip")
        begun = state >> 31
        state ^= begun
        return begun

    def run(self, chars: np.ndarray, state: int) -> tuple[int, int]:
        """Phrases that begin in a sequence of classes, and the state after it."""
        table, count = memoryview(self.table), 0
        for c in chars.tolist():
            state = table[state + c]
            if state < 0:
                state = ~state
                count += 1
        return count, state


@dataclass
class Sparse:
    """Sorted keys (state, from 1, times the width, and class), the states that they lead to, and each class's state at
    a phrase's begin, 0 for none."""

    keys: np.ndarray
    to: np.ndarray
    first: np.ndarray
    kind = np.int64

    def advance(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = state * len(self.first) + c
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        begun = self.keys[at] != key
        state[:] = np.where(begun, self.first[c], self.to[at])
        return -begun.astype(np.int64)

    def run(self, chars: np.ndarray, state: int) -> tuple[int, int]:
        keys, to, first, width, count = memoryview(self.keys), memoryview(self.to), memoryview(self.first), len(self.first), 0
        for c in chars.tolist():
            key = state * width + c
            at = bisect_left(keys, key)
            if at < len(keys) and keys[at] == key:
                state = to[at]
            else:
                state = first[c]
                count += 1
        return count, state


def sparse(rows: list[dict[int, int]], width: int) -> Sparse:
    found = np.array([((k + 1) * width + c, to + 1) for k, row in enumerate(rows) for c, to in row.items()], np.int64).reshape(-1, 2)
    found = found[np.argsort(found[:, 0])]
    first = np.zeros(width, np.int64)
    for c, to in rows[0].items():
        first[c] = to + 1
    return Sparse(found[:, 0].copy(), found[:, 1].copy(), first)


def parse_table(step: np.ndarray) -> Dense:
    width = step.shape[1]
    first = ~np.where(step[0] >= 0, (step[0] + 1) * width, 0)
    inside = np.where(step >= 0, (step + 1) * width, first[None, :])
    return Dense(np.concatenate([first[None, :], inside]).astype(np.int32).ravel())


@dataclass
class Model:
    """classes gives a code point's class (0 for what is no letter), local a class's number in each language's table;
    bits is the cost of a phrase."""

    names: list[str]
    classes: np.ndarray
    width: int
    local: list[np.ndarray]
    tables: list[Dense | Sparse]
    bits: np.ndarray

    def normal(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of the characters with runs of class 0 made one, offsets by document, and letters by document."""
        letter, _ = _letters()
        text = raw.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ahead = np.zeros(len(raw) + 1, np.int32)
        np.cumsum((raw & 0xC0) != 0x80, out=ahead[1:])
        at = ahead[offs]
        del text, ahead
        known = self.classes[points]
        total = np.zeros(len(points) + 1, np.int32)
        np.cumsum(letter[points], out=total[1:])
        letters = total[at[1:]] - total[at[:-1]]
        del points
        keep = np.ones(len(known), bool)
        keep[1:] = (known[1:] != 0) | (known[:-1] != 0)
        keep[at[:-1][at[:-1] < len(known)]] = True
        np.cumsum(keep, out=total[1:])
        return known[keep], total[at].astype(np.int64), letters

    def phrases(self, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of each document (rows) in each language (columns)."""
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        start, length = bounds[:-1][order].astype(np.int32), sizes[order].astype(np.int32)  # a batch has less than 2 GB
        out = np.zeros((len(sizes), len(self.tables)))
        side_by_side = int(length[LANES - 1]) // BLOCK * BLOCK if len(length) >= LANES else 0
        for k, table in enumerate(self.tables):
            own = self.local[k]
            state, count = np.zeros(len(start), table.kind), np.zeros(len(start), np.int64)
            for at in range(0, side_by_side, BLOCK):
                m = int(np.searchsorted(-length, -(at + BLOCK), side="right"))  # those with a whole block left
                for c in own[chars[start[:m, None] + np.arange(at, at + BLOCK, dtype=np.int32)].T]:
                    count[:m] -= table.advance(state[:m], c)
            # what is left of each: for most less than a block, side by side again
            done = np.minimum(length // BLOCK * BLOCK, side_by_side)
            rest = length - done
            turn = np.argsort(-rest, kind="stable")
            alone = int(np.searchsorted(-rest[turn], -BLOCK, side="right")) if side_by_side or len(turn) >= LANES else len(turn)
            for j in turn[:alone]:
                more, _ = table.run(own[chars[start[j] + done[j] : start[j] + length[j]]], int(state[j]))
                count[j] += more
            turn = turn[alone:]
            if len(turn):
                begin, left, now = start[turn] + done[turn], rest[turn], state[turn]
                found, last = np.zeros(len(turn), np.int64), max(len(chars) - 1, 0)
                for t, c in enumerate(own[chars[np.minimum(begin[:, None] + np.arange(int(left[0]), dtype=np.int32), np.int32(last))].T]):
                    m = int(np.searchsorted(-left, -t, side="left"))
                    found[:m] -= table.advance(now[:m], c[:m])
                count[turn] += found
            out[order, k] = count
        return out

    def piecewise(self, raw: np.ndarray) -> tuple[np.ndarray, int, int]:
        """Phrases of one long text in each language, its characters and its letters; phrases, and what is no letter, go
        on over the ends of pieces."""
        count, state = np.zeros(len(self.tables)), [0] * len(self.tables)
        size = letters = a = 0
        space = False
        while a < len(raw):
            b = min(a + PIECE, len(raw))
            while b < len(raw) and (raw[b] & 0xC0) == 0x80:
                b += 1
            chars, _, found = self.normal(raw[a:b], np.array([0, b - a]))
            if space and len(chars) and chars[0] == 0:
                chars = chars[1:]
            space = bool(chars[-1] == 0) if len(chars) else space
            for k, table in enumerate(self.tables):
                more, state[k] = table.run(self.local[k][chars], state[k])
                count[k] += more
            size, letters, a = size + len(chars), letters + int(found[0]), b
        return count, size, letters

    def predict(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language (-1 for none) and score of each text."""
        raw, offs = text_buffer(column)
        n = len(offs) - 1
        if not self.tables or not n:
            return np.full(n, -1, np.int64), np.zeros(n)
        counts, sizes, letters = np.zeros((n, len(self.tables))), np.zeros(n, np.int64), np.zeros(n, np.int64)
        # the classes of all texts, in as few bytes as they need, are made piece by piece and parsed together
        chars = np.zeros(int(offs[-1]) if n else 0, np.uint8 if self.width <= 1 << 8 else np.uint16 if self.width <= 1 << 16 else np.int32)
        at = end = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + PIECE, side="right")) - 1)
            if offs[to] - offs[at] > PIECE:
                counts[at], sizes[at], letters[at] = self.piecewise(raw[offs[at] : offs[to]])
            else:
                found, bounds, letters[at:to] = self.normal(raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
                sizes[at:to] = np.diff(bounds)
                chars[end : end + len(found)] = found
                end += len(found)
            at = to
        short = np.diff(offs) <= PIECE
        counts[short] = self.phrases(chars[:end], np.append(0, np.cumsum(sizes[short])))
        rate = counts * self.bits[None, :] / np.maximum(sizes, 1)[:, None]
        least = rate.min(axis=1, keepdims=True)
        share = 1 / np.exp(-8 * (rate - least) / np.maximum(least, 1e-9)).sum(axis=1)
        read = letters > 0
        return np.where(read, rate.argmin(axis=1), -1), np.where(read, share, 0.0)


def build(texts: dict[str, str]) -> Model:
    """A model from labelled text by language."""
    letter, lower = _letters()
    names = sorted(k for k, v in texts.items() if any(c.isalpha() for c in v))
    points = {k: np.frombuffer(texts[k].encode("utf-32-le", "surrogatepass"), np.uint32) for k in names}
    found = sorted({int(x) for k in names for x in np.unique(lower[points[k][letter[points[k]]]])})
    width = len(found) + 2  # what is no letter, the letters, other letters
    classes = np.zeros(0x110000, np.int32)
    classes[letter] = width - 1
    number = np.zeros(0x110000, np.int32)
    number[found] = np.arange(1, width - 1)
    known = letter & (number[lower] > 0)
    classes[known] = number[lower[known]]
    local, built, bits = [], [], []
    for k in names:
        c = classes[points[k]]
        c = c[np.append(True, ~((c[1:] == 0) & (c[:-1] == 0)))]
        own = np.union1d(c, [0])  # what is no letter is 0 here, too, and letters of other languages are the last
        numbers = np.full(width, len(own), np.int32)
        numbers[own] = np.arange(len(own))
        local.append(numbers)
        built.append((automaton(numbers[c]), len(own) + 1))
        bits.append(np.log2(len(c) + 2))
    tables: list[Dense | Sparse] = [Dense(np.zeros(0, np.int32))] * len(names)
    left = CELLS
    for k in sorted(range(len(names)), key=lambda k: len(built[k][0]) * built[k][1]):  # small tables are dense first
        rows, size = built[k]
        left -= (len(rows) + 1) * size
        tables[k] = parse_table(dense(rows, size)) if left >= 0 else sparse(rows, size)
    return Model(names, classes, width, local, tables, np.array(bits))


@relieved
def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, longest: int = LONGEST) -> Model:
    """A model from a bounded sample of the documents that are not held out and name a language.

    For each language and each value of a hash modulo rows one document is chosen, by partial aggregation: the one with
    the least hash of those with at most longest characters.  What reaches the driver, and the model, grows with the
    number of languages only.
    """
    usable = docs.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t")).filter("i is not null and l is not null and t is not null").filter(~held_out(F.col("i")))
    hashed = usable.select("l", F.xxhash64("i", "t").alias("h"), F.char_length("t").alias("n"))
    over = F.when(F.col("n") <= longest, 0).otherwise(F.col("n"))
    salted = hashed.groupBy("l", F.pmod("h", F.lit(rows)).alias("s")).agg(F.min(F.struct(over.alias("over"), "h")).alias("m"))
    shortest = F.row_number().over(Window.partitionBy("l").orderBy("m"))
    chosen = salted.withColumn("r", shortest).filter("m.over = 0 or r = 1").select(F.col("l").alias("cl"), F.col("m.h").alias("c"))
    same = (F.xxhash64("i", "t") == F.col("c")) & (F.col("l") == F.col("cl"))
    picked = usable.join(F.broadcast(chosen), same).select("cl", "c", "t").dropDuplicates(["cl", "c"])
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in picked.collect():
        texts.setdefault(row["cl"], []).append((row["c"], row["t"]))
    return build({k: "\n".join(t for _, t in sorted(v)) for k, v in texts.items()})


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 4 * CELLS bytes

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*sent.value.names, UNKNOWN], pa.string())
        for batch in batches:
            best, score = sent.value.predict(batch.column(2))
            best[best < 0] = len(names) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names.take(pa.array(best)), pa.array(score, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("_held"), F.col(text_col)).mapInArrow(tidied(predicted), schema)


def drop_unknown(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a language, with all their columns."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array(sent.value.predict(batch.column(at))[0] >= 0)
            for k in range(0, batch.num_rows, 1024):  # in parts, which do not copy the whole batch at a time
                yield batch.slice(k, 1024).filter(good.slice(k, 1024))

    return docs.mapInArrow(tidied(known), docs.schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
