"""Whole plans made of the operators."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions.strings import text_key
from ..functions.validation import source_stance
from ..operators import generation, relational, routing


@dataclass(frozen=True)
class Selection:
    """How candidates are chosen; a flag off or an empty list leaves a step out."""

    sources: tuple[str, ...] = ("VAST", "PStance", "COVID19", "SemEval2016")
    keywords: tuple[str, ...] = (*lexicons.PRIMARY_KEYWORDS, *lexicons.SECONDARY_KEYWORDS, *lexicons.IMMIGRATION_KEYWORDS)
    least_hits: int = 1
    fuzzy: float = 1.0
    permutations: int = 128
    weights: dict[str, float] = field(default_factory=lambda: {"VAST": 2.0})
    per_class: int = 3000
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    """What a command line may set of a construction."""

    per_class: int = 1000
    budget: float = 50.0
    log_level: str = "INFO"

    @property
    def quotas(self) -> dict[str, int]:
        return dict.fromkeys(lexicons.STANCES, self.per_class)


def settings(arguments: list[str] | None = None) -> Settings:
    """Settings from a command line; what it leaves out keeps its default."""
    parser = argparse.ArgumentParser(prog="lexforge")
    parser.add_argument("--samples-per-class", type=int, default=Settings.per_class, help="rows of each class")
    parser.add_argument("--budget", type=float, default=Settings.budget, help="what all rows may cost")
    parser.add_argument("--log-level", default=Settings.log_level, choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    given = parser.parse_args(arguments)
    return Settings(given.samples_per_class, given.budget, given.log_level)


def candidates(rows: DataFrame, gold: DataFrame | None, chosen: Selection = Selection(), *, source: str = "dataset", text: str = "text", stance: str = "stance", order: str = "row_idx") -> DataFrame:  # noqa: B008
    """Sources, keywords, known texts out, duplicates out, and a balanced weighted sample by mapped stance; the cheap
    filters come first."""
    out = relational.source_filter(rows, list(chosen.sources), source) if chosen.sources else rows
    if chosen.keywords:
        out = relational.keyword_filter(out, list(chosen.keywords), least=chosen.least_hits, text=text)
    if gold is not None:
        out = relational.without_known(out, gold, text=text)
    out = relational.fuzzy_dedup(out, chosen.fuzzy, text=text, order=order, permutations=chosen.permutations)
    weight = F.lit(1.0)
    for name, w in chosen.weights.items():
        weight = F.when(F.col(source) == name, F.lit(w)).otherwise(weight)
    mapped = out.withColumn("mapped_stance", source_stance(stance))
    return relational.balanced_sample(mapped, label="mapped_stance", per_class=chosen.per_class, weight=weight, key=order, seed=chosen.seed)


def construct(rows: DataFrame, backend: generation.Backend, *, quotas: dict[str, int], budget: float = 50.0, state: DataFrame | None = None, source: str = "dataset", ident: str = "id") -> DataFrame:
    """Result rows of candidates (row_idx, text, ...): processed in two stages, then routed by quotas and budget."""
    key = F.concat_ws("_", F.col(source), F.col(ident).cast("string"), F.col("row_idx").cast("string"))
    todo = relational.without_processed(rows, state, key) if state is not None else rows
    done = generation.process(todo, backend).withColumn("_hash", text_key("cleaned_text"))
    routed = routing.quota_route(done, order="row_idx", status="status", label="stance", key="_hash", cost="cost_usd", quotas=quotas, budget=budget)
    own = {c: F.col(c) for c in routing.RESULT_COLUMNS if c in routed.columns}
    own |= {"source_dataset": F.col(source), "source_id": F.col(ident), "original_text": F.col("text"), "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")}
    return routing.assemble(routed, own)


def finish(accepted: DataFrame, repaired: DataFrame, reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The final rows, and their distribution."""
    final = routing.merge([accepted, repaired, reviewed])
    return final, routing.summary(final)
