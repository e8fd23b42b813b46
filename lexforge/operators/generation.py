"""Prompts, model backends, generation with validation, bounded repair, costs and prediction.

A backend is any object with complete(messages) -> Reply; it is sent to the workers and used in batches there.  One
asks a service, for generation or for repair; one follows rules and needs no network.  Prompt wording is a parameter: the defaults are this library's own.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions import validation as V
from ..functions.strings import column
from ..session import cut_lineage
from .relational import token_cost

Message = "struct<role:string,content:string>"
FIRST = ("aspect_target", "aspect_category", "opinion_span")
SECOND = ("stance", "explanation")
MOST_REPAIRS = 3
MOST_TRIES = 5


@dataclass(frozen=True)
class Reply:
    text: str
    tokens_in: int
    tokens_out: int


class Backend(Protocol):
    def complete(self, messages: list[dict[str, str]]) -> Reply: ...


@dataclass(frozen=True)
class RuleBackend:
    """Answers from the post itself: longest word as target, its first words as opinion, labels by marker words."""

    categories: tuple[str, ...] = tuple(lexicons.CATEGORIES)

    def complete(self, messages: list[dict[str, str]]) -> Reply:
        asked = messages[-1]["content"]
        post = asked.split("Post: ", 1)[-1].split("\n", 1)[0]
        there = post.split()
        low = post.lower()
        if "Fields: stance" in asked:
            bad, good = (any(m in low for m in marks) for marks in (lexicons.HOSTILE_MARKERS, lexicons.HOPEFUL_MARKERS))
            answer = {"stance": "HATE" if bad and not good else "HOPEFUL" if good and not bad else "NEUTRAL", "explanation": " ".join(there[:12])}
        else:
            hits = [c for c in self.categories if any(w.lower() in low for w in c.split() if len(w) > 3)]
            answer = {"aspect_target": max(there, key=len, default=""), "aspect_category": (hits or list(self.categories))[0], "opinion_span": " ".join(there[:8])}
        text = json.dumps(answer, ensure_ascii=False)
        return Reply(text, sum(len(m["content"].split()) for m in messages), len(text.split()))


@dataclass(frozen=True)
class HttpBackend:
    """A model behind a service that takes model and messages as JSON and answers with choices and usage, as many hosted
    and local servers do; headers carry whatever the service wants to know of its caller."""

    url: str
    model: str
    headers: tuple[tuple[str, str], ...] = ()
    temperature: float = 0.0
    seconds: float = 60.0

    def complete(self, messages: list[dict[str, str]]) -> Reply:
        body = json.dumps({"model": self.model, "messages": messages, "temperature": self.temperature}).encode()
        asked = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **dict(self.headers)})  # noqa: S310  the caller chooses the service
        with urllib.request.urlopen(asked, timeout=self.seconds) as answer:  # noqa: S310
            said = json.load(answer)
        used = said.get("usage", {})
        return Reply(said["choices"][0]["message"]["content"], used.get("prompt_tokens", 0), used.get("completion_tokens", 0))


@dataclass(frozen=True)
class Wording:
    first: str = "Annotate a social media post. Answer with one JSON object. Copy spans from the post."
    second: str = "Judge the stance of an annotated post. Answer with one JSON object. Copy the explanation from the post."
    repair: str = "The last answer had errors. Mend all of them and answer with one JSON object."
    definitions: dict[str, str] = field(default_factory=dict)


def inventory(names: list[str], definitions: dict[str, str], *, numbered: bool = True) -> str:
    """A line for each name with its definition, numbered or marked."""
    return "\n".join(f"{k}. {n}: {definitions.get(n, '')}" if numbered else f"   - {n}: {definitions.get(n, '')}" for k, n in enumerate(names, 1))


def _message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), (F.lit(content) if isinstance(content, str) else content).alias("content"))


def pretty(fields: dict[str, Column | str]) -> Column:
    """The fields as JSON with an indent of two."""
    plain = {"ignoreNullFields": "false"}
    lines = [F.concat(F.lit(f'  "{k}": '), F.regexp_replace(F.to_json(F.struct((column(v) if isinstance(v, str) else v).alias("v")), plain), r'^\{"v":|\}$', "")) for k, v in fields.items()]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def prompt(text: Column | str, *, stage: int, shots: list[dict[str, str]] | None = None, wording: Wording | None = None, given: dict[str, Column | str] | None = None, categories: list[str] | None = None) -> Column:
    """The messages of a stage: instructions, examples as exchanges, and the post, in stage 2 with what stage 1 found."""
    wording = wording or Wording()
    asked = FIRST if stage == 1 else SECOND
    names = (categories or lexicons.CATEGORIES) if stage == 1 else lexicons.STANCES
    system = f"{wording.first if stage == 1 else wording.second}\n{inventory(names, wording.definitions, numbered=stage == 1)}"
    parts = [_message("system", system)]
    for shot in shots or []:
        parts.append(_message("user", f"Post: {shot['text']}\nFields: {', '.join(asked)}"))
        parts.append(_message("assistant", json.dumps({f: shot.get(f, "") for f in asked}, indent=2, ensure_ascii=False)))
    body = [F.lit("Post: "), F.coalesce(column(text), F.lit(""))]
    if given:
        body += [F.lit("\nAnnotation: "), pretty(given)]
    parts.append(_message("user", F.concat(*body, F.lit(f"\nFields: {', '.join(asked)}"))))
    return F.array(*parts).cast(f"array<{Message}>")


def error_messages(errors: Column | str) -> Column:
    """What to tell a model about each error."""

    def told(e: Column) -> Column:
        kind, name, why = e["error_type"], e["field"], e["message"]
        return (
            F.when(kind == "missing_field", F.concat(F.lit("Field '"), name, F.lit("' is missing or empty.")))
            .when(kind == "invalid_category", F.concat(F.lit("Category '"), why, F.lit("' is not in the list.")))
            .when(kind == "invalid_label", F.concat(F.lit("Stance "), why))
            .when(kind.isin("unsupported_span", "ungrounded_rationale"), F.concat(F.lit("The "), name, F.lit(" is not in the post: copy it exactly. "), F.coalesce(why, F.lit(""))))
            .when(kind == "parse_error", F.lit("The output is not JSON: answer with JSON only."))
            .otherwise(F.concat(kind, F.lit(": "), why))
        )

    return F.transform(column(errors), told)


def repair_prompt(text: Column | str, previous: dict[str, Column | str], errors: Column | str, *, stage: int, wording: Wording | None = None) -> Column:
    wording = wording or Wording()
    asked = FIRST if stage == 1 else SECOND
    bullets = F.array_join(F.transform(error_messages(errors), lambda m: F.concat(F.lit("- "), m)), "\n")
    system = F.concat(F.lit(f"{wording.repair}\n"), bullets)
    user = F.concat(F.lit("Post: "), F.coalesce(column(text), F.lit("")), F.lit("\nAnswer so far: "), pretty(previous), F.lit(f"\nFields: {', '.join(asked)}"))
    return F.array(_message("system", system), _message("user", user)).cast(f"array<{Message}>")


def generate(rows: DataFrame, backend: Backend, *, messages: str = "messages", prefix: str = "s1", tries: int = MOST_TRIES, pause: float = 0.0) -> DataFrame:
    """rows with prefix_raw, prefix_tokens_in and prefix_tokens_out.  A failing backend is tried again, after pauses
    that double; if all tries fail the answer is null and costs nothing."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField(f"{prefix}_raw", T.StringType()), T.StructField(f"{prefix}_tokens_in", T.LongType()), T.StructField(f"{prefix}_tokens_out", T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for asked in frame[messages]:
                reply = Reply("", 0, 0)
                raw = None
                for k in range(tries):
                    try:
                        reply = backend.complete([dict(m) if isinstance(m, dict) else m.asDict() for m in asked])
                        raw = reply.text
                        break
                    except Exception:  # noqa: BLE001  whatever a backend raises counts as a failed try
                        time.sleep(pause * 2**k)
                found.append((raw, reply.tokens_in, reply.tokens_out))
            extra = pd.DataFrame(found, columns=[f"{prefix}_raw", f"{prefix}_tokens_in", f"{prefix}_tokens_out"], index=frame.index)
            yield pd.concat([frame, extra], axis=1)

    return rows.mapInPandas(run, schema)


def read_answer(rows: DataFrame, raw: str, fields: tuple[str, ...], error: str = "parse_error") -> DataFrame:
    """rows with the fields of the JSON object in raw, and why it could not be read."""
    parsed = rows.withColumn("_o", V.parse_object(F.col(raw)))
    for f in fields:
        parsed = parsed.withColumn(f, F.get_json_object(F.col("_o.json"), f"$.{f}"))
    return parsed.withColumn(error, F.col("_o.error")).drop("_o")


def annotate(rows: DataFrame, backend: Backend, *, stage: int, repairer: Backend | None = None, text: str = "cleaned_text", shots: list[dict[str, str]] | None = None, wording: Wording | None = None, repairs: int = MOST_REPAIRS) -> DataFrame:
    """One stage for all rows: generate, read, validate, mend plainly, and ask again for what still has errors.

    Adds the stage's fields, sN_valid, sN_failed, sN_errors, sN_auto_fixed, sN_attempts and sN_cost.  A first answer
    that is no JSON object has failed and is not repaired.  Each repair round asks for the rows with errors only; the
    rounds are bounded and their results are checkpointed.
    """
    fields, p = (FIRST, "s1") if stage == 1 else (SECOND, "s2")
    given = dict(zip(FIRST, FIRST, strict=True)) if stage == 2 else None
    asked = generate(rows.withColumn("messages", prompt(text, stage=stage, shots=shots, wording=wording, given=given)), backend, prefix=p)
    out = read_answer(asked, f"{p}_raw", fields)

    def validated(frame: DataFrame) -> DataFrame:
        checked = V.validate_first(frame, text=text) if stage == 1 else V.validate_second(frame, text=text)
        unread = F.col("parse_error").isNotNull()
        broken = F.array(V.error("parse_error", "output", F.col("parse_error"))).cast(f"array<{V.ERROR}>")
        return checked.withColumn("errors", F.when(unread, broken).otherwise(F.col("errors"))).withColumn("valid", F.col("valid") & ~unread)

    def mended(frame: DataFrame) -> DataFrame:
        if stage == 1:
            return V.repair_plainly(frame, text=text)
        return V.repair_plainly(frame, text=text, spans=("explanation",), category=None, stance="stance")

    state = validated(out).withColumn(f"{p}_attempts", F.lit(1)).withColumn(f"{p}_cost", token_cost(F.col(f"{p}_tokens_in"), F.col(f"{p}_tokens_out")))
    state = state.withColumn(f"{p}_failed", F.col("parse_error").isNotNull())
    state = cut_lineage(state.drop("messages", f"{p}_raw", f"{p}_tokens_in", f"{p}_tokens_out"))
    base = state.columns
    done, bad = state.filter(f"valid or {p}_failed"), state.filter(f"not valid and not {p}_failed")
    # what can be mended without a model costs no attempt
    if not bad.isEmpty():
        tried = cut_lineage(validated(mended(bad).drop("errors", "auto_fixed", "valid")))
        good = tried.filter("valid and repaired").select(*base)
        keys = good.select("row_idx")
        done = done.unionByName(good)
        bad = cut_lineage(bad.join(keys, "row_idx", "left_anti"))
        for k in range(repairs):
            if bad.isEmpty():
                break
            again = bad.withColumn("messages", repair_prompt(text, dict(zip(fields, fields, strict=True)), "errors", stage=stage, wording=wording))
            answered = generate(again, repairer or backend, prefix="r", tries=1)
            kept = {f: f"_kept_{f}" for f in fields}
            for f, old in kept.items():
                answered = answered.withColumn(old, F.col(f))
            read = read_answer(answered.drop("parse_error"), "r_raw", fields)
            unread = F.col("parse_error").isNotNull()
            for f, old in kept.items():  # an answer that cannot be read changes nothing but the errors
                read = read.withColumn(f, F.when(unread, F.col(old)).otherwise(F.col(f)))
            checked = validated(mended(read.drop("errors", "auto_fixed", "valid")))
            checked = cut_lineage(checked.withColumn(f"{p}_attempts", F.lit(k + 2)).select(*base))
            done = done.unionByName(checked.filter("valid"))
            bad = checked.filter("not valid")
        ended = validated(bad.withColumn("parse_error", F.lit(None).cast("string")).drop("errors", "auto_fixed", "valid"))
        done = done.unionByName(ended.select(*base))
    for name in ("valid", "errors", "auto_fixed"):
        done = done.withColumnRenamed(name, f"{p}_{name}")
    return done.drop("parse_error")


def process(rows: DataFrame, backend: Backend, *, repairer: Backend | None = None, cleaned: Column | None = None, shots: list[dict[str, str]] | None = None, wording: Wording | None = None) -> DataFrame:
    """Both stages for all rows (row_idx, text): status is filtered, failed, review, accepted or repaired, and errors says why."""
    from ..functions.cleaning import clean_text
    from .routing import status_of

    own = cut_lineage(rows.withColumn("cleaned_text", cleaned if cleaned is not None else clean_text("text")))
    gone = own.filter("cleaned_text is null").withColumn("status", F.lit("filtered"))
    first = annotate(own.filter("cleaned_text is not null"), backend, stage=1, repairer=repairer, shots=shots, wording=wording)
    failed = first.filter("not s1_valid").withColumn("status", F.when(F.col("s1_failed"), "failed").otherwise("review"))
    failed = failed.withColumn("errors", F.when(F.col("s1_failed"), F.lit("Stage 1 generation returned None")).otherwise(V.error_text("s1_errors", "Stage 1 repair failed: ")))
    second = annotate(first.filter("s1_valid"), backend, stage=2, repairer=repairer, shots=shots, wording=wording)
    ended = second.withColumn("status", F.when(F.col("s2_valid"), status_of("s1_attempts", "s2_attempts", "s1_auto_fixed", "s2_auto_fixed")).when(F.col("s2_failed"), "failed").otherwise("review"))
    why = F.when(F.col("s2_valid"), F.lit("")).when(F.col("s2_failed"), F.lit("Stage 2 generation returned None")).otherwise(V.error_text("s2_errors", "Stage 2 repair failed: "))
    ended = ended.withColumn("errors", why)
    whole = ended.unionByName(failed, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)
    cost = F.coalesce(F.col("s1_cost"), F.lit(0.0)) + F.coalesce(F.col("s2_cost"), F.lit(0.0))
    return whole.withColumn("cost_usd", F.format_string("%.6f", cost))


def predict(rows: DataFrame, backend: Backend, *, text: str = "text", repairer: Backend | None = None) -> DataFrame:
    """rows with the five fields, or with what failed in error; nothing is cleaned or routed."""
    own = rows.withColumn("cleaned_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    if "row_idx" not in own.columns:
        own = own.withColumn("row_idx", F.monotonically_increasing_id())
    first = annotate(cut_lineage(own), backend, stage=1, repairer=repairer)
    failed = first.filter("not s1_valid").withColumn("error", F.when(F.col("s1_failed"), F.lit("stage1 failed")).otherwise(F.lit("stage1 repair failed")))
    second = annotate(first.filter("s1_valid"), backend, stage=2, repairer=repairer)
    ended = second.withColumn("error", F.when(F.col("s2_failed"), F.lit("stage2 failed")).when(~F.col("s2_valid"), F.lit("stage2 repair failed")))
    whole = ended.unionByName(failed, allowMissingColumns=True)
    kept = [F.when(F.col("error").isNull(), F.col(f)).alias(f) for f in (*FIRST, *SECOND)]
    return whole.select(*rows.columns, *kept, "error")


def cost_summary(rows: DataFrame, *, tokens_in: str = "tokens_in", tokens_out: str = "tokens_out", stage: str = "stage") -> DataFrame:
    """Tokens and cost of each stage and of all together (stage null)."""
    return rows.rollup(stage).agg(F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"), F.sum(token_cost(F.col(tokens_in), F.col(tokens_out))).alias("cost_usd"))


def rewrite_batches(rows: DataFrame, backend: Backend, *, text: str = "cleaned_text", size: int = 25, tries: int = 3) -> DataFrame:
    """rows with related, confidence and rewrite, asked for in numbered batches of posts; a batch that fails gives nulls.
    relevance_gate() reads the result."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("related", T.BooleanType()), T.StructField("confidence", T.DoubleType()), T.StructField("rewrite", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size].copy()
                listed = "\n".join(f"{k}. {t}" for k, t in enumerate(part[text], 1))
                answers: dict[int, dict] = {}
                for _ in range(tries):
                    try:
                        got = json.loads(backend.complete([{"role": "user", "content": f"Rate and rewrite:\n{listed}"}]).text)
                        answers = {int(r["id"]): r for r in got["results"]}
                        break
                    except Exception:  # noqa: BLE001, S112  a failed batch is tried again
                        continue
                one = [answers.get(k, {}) for k in range(1, len(part) + 1)]
                part["related"] = pd.array([r.get("related") for r in one], dtype="boolean")
                part["confidence"] = pd.array([r.get("confidence") for r in one], dtype="Float64")
                part["rewrite"] = [r.get("rewrite") for r in one]
                yield part

    return rows.mapInPandas(run, schema)


__all__ = ["Backend", "HttpBackend", "Reply", "RuleBackend", "Wording", "annotate", "cost_summary", "error_messages", "generate", "inventory", "predict", "pretty", "process", "prompt", "read_answer", "repair_prompt", "rewrite_batches"]
