"""Structured Streaming forms: extensions beyond batch processing.

Cleaning and validation hold no state and run on a stream as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.cleaning import cleaned_rows
from ..functions.strings import text_key


def cleaned(stream: DataFrame, text: str = "text") -> DataFrame:
    """The stream with cleaned_text, without what cleaning drops."""
    return cleaned_rows(stream, text)


def unique(stream: DataFrame, *, text: str = "text", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each text within the delay; later state is dropped."""
    return stream.withColumn("text_hash", text_key(text)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["text_hash"])


def windowed_counts(stream: DataFrame, label: str, *, time: str = "ts", delay: str = "10 minutes", length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Rows by label and window; late rows count until the watermark passes."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, length, slide), label).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, user: str, *, time: str = "ts", delay: str = "10 minutes", gap: str = "5 minutes") -> DataFrame:
    """Rows by user and session, which ends after a gap."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n"))


def first_by_quota(stream: DataFrame, *, label: str, key: str, quotas: dict[str, int]) -> DataFrame:
    """Rows of each label with new keys until the label's quota is full.  State is kept by label, at most quota keys;
    a key counts once in its label."""
    fields = [f for f in stream.schema.fields]
    schema = stream.schema

    def take(name: tuple[str, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        known, room = set(seen), quotas.get(name[0], 0)
        for frame in frames:
            kept = []
            for at, k in zip(frame.index, frame[key], strict=True):
                if len(known) < room and k not in known:
                    known.add(k)
                    seen.append(k)
                    kept.append(at)
            if kept:
                yield frame.loc[kept, [f.name for f in fields]]
        state.update((seen,))

    return stream.groupBy(label).applyInPandasWithState(take, schema, "keys array<string>", "append", GroupStateTimeout.NoTimeout)
