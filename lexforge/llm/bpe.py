"""Operators 2 and 5: byte-level BPE by prefix dynamic programming, and token counts.

For every prefix of a piece the table keeps the last token of the prefix's only
valid encoding.  A token may follow another only if byte-pair merging would not
merge across their boundary, which is decided by undoing merges from both sides.
Appending bytes only extends the table, so appends are exact.

Nulls count as empty text; empty text has no tokens; every row gives one row.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textops import REMEMBERED as REMEMBERED_BY_WORKERS
from .textops import tidied, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Distinct pieces whose ids a worker remembers: twice so many at most, about 200 bytes each.  When the younger half is
#: full it becomes the older one, whose pieces go if they are not met again meanwhile.  A piece is remembered when it is
#: met for the second time, as a table of so many marks tells, which is emptied when half full.
REMEMBERED = 163_840
MARKS = 1 << 21
#: Pairs of tokens of which a worker remembers whether they fit; emptied when full.
PAIRS = 262_144


class PrefixTable:
    """Last tokens of all prefixes of a growing byte string."""

    __slots__ = ("bpe", "data", "last", "width")

    def __init__(self, bpe: Bpe, data: bytes = b"") -> None:
        self.bpe, self.data, self.last, self.width = bpe, b"", [-1], [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extends the table; what it already holds stays valid.  An automaton over all tokens names those that end at
        each byte, longest first; the first one that its prefix's last token lets follow is the last of the longer prefix."""
        known, fits, last, width = self.bpe.known_fits.get, self.bpe.fits, self.last, self.width
        old = len(self.data)
        self.data += more
        text = self.data.decode("latin-1")
        last += [-1] * len(more)
        width += [0] * len(more)
        done = old - 1
        for end, (size, token) in self.bpe.endings(text, max(0, old - self.bpe.longest + 1)):
            if end <= done:
                continue
            start = end + 1 - size
            if start:
                before = last[start]
                good = known(before << 20 | token)
                if not (fits(before, token) if good is None else good):
                    continue
            last[end + 1], width[end + 1], done = token, size, end

    def truncate(self, size: int) -> None:
        """Goes back to the first size bytes."""
        self.data = self.data[:size]
        del self.last[size + 1 :], self.width[size + 1 :]

    def ids(self) -> list[int]:
        at, out = len(self.data), []
        while at:
            out.append(self.last[at])
            at -= self.width[at]
        return out[::-1]


@dataclass
class Encoded:
    """A text, where its pieces begin and end, and their ids."""

    text: str
    starts: list[int]
    ends: list[int]
    pieces: list[tuple[int, ...]]

    def ids(self) -> list[int]:
        return [i for p in self.pieces for i in p]


class Bpe:
    """Encoder and decoder over a file of ranks."""

    def __init__(self, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for data, rank in self.ranks.items():
            self.token[rank] = data
        self.longest = max(map(len, self.ranks))
        automaton = ahocorasick.Automaton()
        for data, rank in self.ranks.items():
            automaton.add_word(data.decode("latin-1"), (len(data), rank))
        automaton.make_automaton()
        self.endings = automaton.iter
        self.pieces, self.matches = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.halves: list[tuple[int, int]] = [(-1, -1)] * len(self.token)
        for data, rank in self.ranks.items():
            self.halves[rank] = self._halves(data, rank)
        self.known_fits: dict[int, bool] = {}
        self._memory: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self._met, self._marked = bytearray(MARKS), 0

    def _halves(self, data: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; the token itself, twice, for a byte."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return rank, rank  # no merge reaches it; it is used only for a whole piece
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (rank, rank)

    def fits(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps a boundary between the two tokens."""
        key = left << 20 | right
        known = self.known_fits.get(key)
        if known is None:
            if len(self.known_fits) >= PAIRS:
                self.known_fits.clear()
            known = self.known_fits[key] = self._boundary(left, right)
        return known

    def _boundary(self, left: int, right: int) -> bool:
        ceiling = len(self.token) + 1  # merges from here on happen after the boundary's tokens are complete
        while True:
            joined = self.ranks.get(self.token[left] + self.token[right])
            if joined is not None and joined < ceiling:
                return False
            undo_left = left > right  # the later merge is undone first
            for side in (undo_left, not undo_left):
                if side and self.halves[left][1] != left:
                    ceiling, left = left, self.halves[left][1]
                    break
                if not side and self.halves[right][0] != right:
                    ceiling, right = right + 1, self.halves[right][0]
                    break
            else:
                return True

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        found = self._memory.get(text)
        if found is not None:
            return found
        found = self._older.get(text)
        if found is None:
            data = text.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            found = (whole,) if whole is not None else tuple(PrefixTable(self, data).ids())
            at = hash(text) % MARKS
            if not self._met[at]:
                if 2 * self._marked > MARKS:
                    self._met, self._marked = bytearray(MARKS), 0
                self._met[at] = 1
                self._marked += 1
                return found
        if len(text) <= 64:
            if len(self._memory) >= REMEMBERED:
                self._older = dict(self._memory)
                self._memory.clear()  # callers hold its get
            self._memory[text] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            known, piece, more = self._memory.get, self.piece, out.extend
            for p in self.pieces(text):
                more(known(p) or piece(p))
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, piece = self._memory.get, self.piece
        return sum(len(known(p) or piece(p)) for p in self.pieces(text))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def encoded(self, text: str) -> Encoded:
        """A text with its pieces, for edits."""
        spans = [m.span() for m in self.matches(text)]
        return Encoded(text, [a for a, _ in spans], [b for _, b in spans], [self.piece(text[a:b]) for a, b in spans])

    def edited(self, old: Encoded, start: int, end: int, new: str) -> Encoded:
        """The text after text[start:end] has become new: it is split anew from the last boundary before the edit, only
        as far as the boundaries agree again with those of the old text, and only new pieces are encoded."""
        text = old.text[:start] + new + old.text[end:]
        shift = len(text) - len(old.text)
        kept = max(bisect_left(old.ends, start) - 1, 0)  # the last one's match may have looked past its end
        starts, ends, ids = old.starts[:kept], old.ends[:kept], old.pieces[:kept]
        for m in self.matches(text, ends[-1] if ends else 0):
            if m.start() - shift >= end:
                k = bisect_left(old.starts, m.start() - shift)
                if k < len(old.starts) and old.starts[k] == m.start() - shift:
                    starts += [x + shift for x in old.starts[k:]]
                    ends += [x + shift for x in old.ends[k:]]
                    ids += old.pieces[k:]
                    break
            starts.append(m.start())
            ends.append(m.end())
            ids.append(self.piece(m[0]))
        return Encoded(text, starts, ends, ids)

    def reencode(self, old: str, start: int, end: int, new: str) -> tuple[str, list[int]]:
        """The text and its ids after old[start:end] has become new."""
        changed = self.edited(self.encoded(old), start, end, new)
        return changed.text, changed.ids()


@lru_cache(maxsize=4)
def bpe(path: str = VOCABULARY) -> Bpe:
    """One encoder for each Python worker, until it runs another operator."""
    return Bpe(path)


REMEMBERED_BY_WORKERS["bpe"] = bpe.cache_clear


def encode_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every text, and the ids themselves with keep_ids."""
    from pyspark.sql import types as T

    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, digests, decoded, kept = [], [], [], []
                for text in part.column(1):
                    ids = coder.encode(text.as_py())
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(array("I", ids).tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(ids)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(tidied(encoded, "bpe"), T.StructType(fields))


def decode_ids(tokens: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """id and text of every row of ids; bytes that are not UTF-8 become U+FFFD, null ids give null."""
    from pyspark.sql import types as T

    out = T.StructType([T.StructField(id_col, tokens.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        for batch in batches:
            texts = [None if x is None else coder.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=out.names)

    return tokens.select(id_col, ids_col).mapInArrow(tidied(decoded, "bpe"), out)


def length_histogram(docs: DataFrame, *, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): the number of documents of every encoded length; each task sends one row per length."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, found = bpe(vocabulary), {}
        for batch in batches:
            for text in batch.column(0):
                n = coder.count(text.as_py())
                found[n] = found.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["n_tokens", "n_docs"])

    return docs.select(text_col).mapInArrow(tidied(counted, "bpe"), "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame, *, span: int = 256) -> DataFrame:
    """For every length L that occurs: documents and tokens at L or more, and what all documents hold when cut at L.

    The sums run within spans of lengths and then over the spans, so that no task sorts all lengths.  quantile is the
    share of documents no longer than L.  An empty histogram gives no rows.
    """
    blocks = histogram.withColumn("block", F.floor(F.col("n_tokens") / span))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    tops = (
        blocks.groupBy("block")
        .agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
        .select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"), F.sum("d").over(every).alias("docs"), F.sum("t").over(every).alias("tokens"))
    )
    down = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    at_least, tokens_from = F.sum("n_docs").over(down) + F.col("docs_after"), F.sum(F.col("n_docs") * F.col("n_tokens")).over(down) + F.col("tokens_after")
    return (
        blocks.join(tops, "block")
        .select("n_tokens", "n_docs", at_least.alias("docs_at_least"), tokens_from.alias("tokens_at_least"), "docs", "tokens")
        .select(
            "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
            (F.col("tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("tokens_if_cut"),
            ((F.col("docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs")).alias("quantile"),
            "docs", "tokens",
        )
    )


def context_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit, from suffix_sums(): documents longer than it, tokens kept when every document is cut
    there, and documents.  Those longer are the documents from the next length that occurs on, and what they keep is the
    limit; all others keep all their tokens.  Without documents there are no rows."""
    asked = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits]))
    above = F.col("n_tokens") > F.col("context")
    next_up = F.min(F.when(above, F.struct("n_tokens", "docs_at_least", "tokens_at_least")))
    found = sums.select("*", asked.alias("context")).groupBy("context").agg(next_up.alias("up"), F.max(F.struct("docs", "tokens")).alias("all"))
    over, beyond = F.coalesce("up.docs_at_least", F.lit(0)), F.coalesce("up.tokens_at_least", F.lit(0))
    return found.select("context", over.alias("docs_over"), (F.col("all.tokens") - beyond + over * F.col("context")).alias("tokens_kept"), F.col("all.docs").alias("docs"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the histogram is small and read twice: written, so that the texts are encoded once
    return suffix_sums(written(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")), "histogram")).drop("docs", "tokens")
