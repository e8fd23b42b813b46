"""Checks and normal forms of structured annotations.

What built-in expressions decide is decided in the JVM; the Arrow functions get nulls for those rows and pass over
them, so only spans and categories that need fuzzy matching cost time there, and plans stay linear.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicons
from .similarity import best_partial, closest_window, indel_ratio, plainly_grounded, token_f1
from .strings import blank, column, literal_map, strip

SPAN_F1 = 0.6
RATIONALE_F1 = 0.5
PARTIAL = 85.0
CATEGORY_RATIO = 75.0
ERROR = "struct<error_type:string,field:string,message:string>"


def _object(raw: str | None) -> tuple[str | None, str | None]:
    if raw is None:
        raw = ""
    raw = raw.strip()
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", raw, re.DOTALL)
    if fenced:
        raw = fenced[1]
    inner = re.search(r"\{[^{}]*\}", raw, re.DOTALL)
    for text in (raw, inner[0] if inner else None):
        if text is None:
            continue
        try:
            value = json.loads(text)
        except (json.JSONDecodeError, RecursionError):
            continue
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False), None
    return None, f"Could not parse JSON from output: {raw[:200]}"


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())]))
def _parsed(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_object(x) for x in raw], columns=["json", "error"])


def parse_object(raw: Column | str) -> Column:
    """The object of a model's output as JSON: of a fenced block, of the whole text, or the first without inner braces;
    else null and a message.  What is one plain object stays as it is, in the JVM."""
    text = strip(raw)
    # in brackets, so that what follows an object is no end of the text
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    single = F.schema_of_variant(F.try_variant_get(whole, "$[0]", "variant")).startswith("OBJECT") & F.try_variant_get(whole, "$[1]", "variant").isNull()
    plain = F.coalesce(text.startswith("{") & text.endswith("}") & ~F.contains(text, F.lit("```")) & single, F.lit(False))
    rest = _parsed(F.when(~plain, F.coalesce(column(raw), F.lit(""))))
    return F.struct(F.when(plain, text).otherwise(rest["json"]).alias("json"), F.when(~plain, rest["error"]).alias("error"))


def error(kind: str, field: str, message: Column | str) -> Column:
    return F.struct(F.lit(kind).alias("error_type"), F.lit(field).alias("field"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def gather(*errors: Column) -> Column:
    """The errors that are not null."""
    return F.array_compact(F.array(*errors)).cast(f"array<{ERROR}>")


def missing_fields(fields: dict[str, Column]) -> Column:
    return gather(*[F.when(blank(c), error("missing_field", name, f"Field '{name}' is missing or empty")) for name, c in fields.items()])


def normal_stance(raw: Column | str, labels: list[str] | None = None, variants: dict[str, str] | None = None) -> Column:
    """The label, its upper-case form, or what the variants say of it without and with case; else null."""
    labels, variants = labels or lexicons.STANCES, variants or lexicons.STANCE_VARIANTS
    s, table = strip(raw), literal_map(variants)
    return F.when(s.isin(labels), s).when(F.upper(s).isin(labels), F.upper(s)).otherwise(F.coalesce(F.try_element_at(table, F.lower(s)), F.try_element_at(table, s)))


def source_stance(raw: Column | str) -> Column:
    """The stance of a source label; what is not known is NEUTRAL."""
    return F.coalesce(F.try_element_at(literal_map(lexicons.STANCE_OF_SOURCE), F.upper(strip(raw))), F.lit("NEUTRAL"))


def known_category(raw: Column | str, categories: list[str] | None = None, variants: dict[str, str] | None = None) -> Column:
    """A category, what a variant stands for, or the category without case; else null."""
    categories, variants = categories or lexicons.CATEGORIES, variants or lexicons.CATEGORY_VARIANTS
    s = strip(raw)
    lower = literal_map({c.lower(): c for c in reversed(categories)})
    return F.when(s.isin(categories), s).otherwise(F.coalesce(F.try_element_at(literal_map(variants), s), F.try_element_at(lower, F.lower(s))))


def fuzzy_category(categories: list[str] | None = None):  # noqa: ANN201
    """An Arrow function for the category most like a text, if its ratio is 75 or more; the first of equals."""
    names = list(categories or lexicons.CATEGORIES)

    @F.pandas_udf("string")
    def nearest(raw: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if not x or not x.strip():
                return None
            scores = [indel_ratio(x.strip().lower(), c.lower()) for c in names]
            top = max(scores)
            return names[scores.index(top)] if top >= CATEGORY_RATIO else None

        return raw.map(one)

    return nearest


def normal_category(rows: DataFrame, raw: str, out: str, categories: list[str] | None = None) -> DataFrame:
    """rows with the normal category; only texts without a plain match are compared letter by letter."""
    plain = known_category(raw, categories)
    near = fuzzy_category(categories)(F.when(plain.isNull() & ~blank(raw), column(raw)))
    return rows.withColumn(out, F.coalesce(plain, near))


def consistent(stance: Column | str, opinion: Column | str) -> Column:
    """False for HATE with hopeful words only and for HOPEFUL with hostile words only."""
    s, o = F.upper(column(stance)), F.lower(F.coalesce(column(opinion), F.lit("")))
    hostile, hopeful = (F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(o, m)) for marks in (lexicons.HOSTILE_MARKERS, lexicons.HOPEFUL_MARKERS))
    return ~F.coalesce((s == "HATE") & hopeful & ~hostile | (s == "HOPEFUL") & hostile & ~hopeful, F.lit(False))


def grounding(rows: DataFrame, span: str, text: str, out: str, threshold: float = SPAN_F1) -> DataFrame:
    """rows with out: a struct of grounded and, where it is not, the closest run of words (or null)."""
    plain = plainly_grounded(span, text, threshold)

    @F.pandas_udf("grounded boolean, closest string")
    def fuzzy(s: pd.Series, t: pd.Series) -> pd.DataFrame:
        found = []
        for a, b in zip(s, t, strict=True):
            good = bool(a and b) and best_partial(a.lower().strip(), b.lower().strip(), PARTIAL) >= PARTIAL
            found.append((good, None if good else closest_window(a, b)))
        return pd.DataFrame(found, columns=["grounded", "closest"])

    near = fuzzy(F.when(~plain, column(span)), F.when(~plain, column(text)))
    marked = rows.withColumn("_plain", plain).withColumn("_near", near)
    return marked.withColumn(out, F.struct((F.col("_plain") | F.col("_near.grounded")).alias("grounded"), F.col("_near.closest").alias("closest"))).drop("_plain", "_near")


def validate_first(rows: DataFrame, text: str = "text", target: str = "aspect_target", category: str = "aspect_category", opinion: str = "opinion_span", categories: list[str] | None = None) -> DataFrame:
    """rows with their annotation mended where that is safe, and errors, valid and auto_fixed.

    Where a field is missing nothing else is checked; what is mended is not checked again.
    """
    own = rows.withColumn("_missing", missing_fields({"aspect_target": column(target), "aspect_category": column(category), "opinion_span": column(opinion)}))
    own = normal_category(own, category, "_category", categories)
    own = grounding(grounding(own, target, text, "_target"), opinion, text, "_opinion")
    whole = F.size("_missing") == 0
    exact = strip(category).isin(categories or lexicons.CATEGORIES)

    def span_error(state: str, name: str) -> Column:
        return F.when(~F.col(state)["grounded"] & F.col(state)["closest"].isNull(), error("unsupported_span", name, F.concat(F.lit(f"Span not found in post: '"), column(target if name == "aspect_target" else opinion), F.lit("'"))))

    found = gather(F.when(F.col("_category").isNull(), error("invalid_category", "aspect_category", column(category))), span_error("_target", "aspect_target"), span_error("_opinion", "opinion_span"))
    fixed = whole & (~exact & F.col("_category").isNotNull() | F.col("_target")["closest"].isNotNull() | F.col("_opinion")["closest"].isNotNull())
    out = own.withColumn("errors", F.when(whole, found).otherwise(F.col("_missing"))).withColumn("auto_fixed", F.coalesce(fixed, F.lit(False)))
    out = out.withColumn(category, F.when(whole, F.coalesce("_category", category)).otherwise(column(category)))
    for name, state in ((target, "_target"), (opinion, "_opinion")):
        out = out.withColumn(name, F.when(whole, F.coalesce(F.col(state)["closest"], name)).otherwise(column(name)))
    return out.withColumn("valid", F.size("errors") == 0).drop("_missing", "_category", "_target", "_opinion")


def validate_second(rows: DataFrame, text: str = "text", stance: str = "stance", explanation: str = "explanation", opinion: str = "opinion_span") -> DataFrame:
    """As validate_first, for stance and explanation; an upper-case form of a label is stored without being a fix."""
    own = rows.withColumn("_missing", missing_fields({"stance": column(stance), "explanation": column(explanation)}))
    own = grounding(own, explanation, text, "_why", RATIONALE_F1)
    whole = F.size("_missing") == 0
    upper = F.upper(strip(stance))
    plain = upper.isin(lexicons.STANCES)
    label = F.when(plain, upper).otherwise(normal_stance(stance))
    fixed = ~plain & label.isNotNull() | F.col("_why")["closest"].isNotNull()
    score = F.format_string("%.2f", token_f1(explanation, text))
    found = gather(
        F.when(label.isNull(), error("invalid_label", "stance", F.concat(F.lit("'"), strip(stance), F.lit(f"' is not valid. Must be one of: {lexicons.STANCES}")))),
        F.when(~F.col("_why")["grounded"] & F.col("_why")["closest"].isNull(), error("ungrounded_rationale", "explanation", F.concat(F.lit("Explanation not grounded in post (grounding_F1="), score, F.lit(")")))),
        F.when(~consistent(F.coalesce(label, stance), opinion), error("label_inconsistency", "stance", F.concat(F.lit("Stance is "), F.coalesce(label, stance), F.lit(" but the opinion says otherwise")))),
    )
    out = own.withColumn("errors", F.when(whole, found).otherwise(F.col("_missing"))).withColumn("auto_fixed", F.coalesce(whole & fixed, F.lit(False)))
    out = out.withColumn("_label", F.when(whole, F.coalesce(label, stance)).otherwise(column(stance))).withColumn(explanation, F.when(whole, F.coalesce(F.col("_why")["closest"], explanation)).otherwise(column(explanation)))
    return out.withColumn(stance, F.col("_label")).withColumn("valid", F.size("errors") == 0).drop("_missing", "_why", "_label")


def repair_plainly(rows: DataFrame, text: str = "text", spans: tuple[str, ...] = ("aspect_target", "opinion_span"), category: str | None = "aspect_category", stance: str | None = None) -> DataFrame:
    """rows with categories, stances and spans mended without a model, and repaired; a span is replaced by the closest
    run of words wherever it is not in the text to the letter, case aside."""
    out = rows.withColumn("repaired", F.lit(False))
    if category:
        out = normal_category(out, category, "_normal")
        other = F.col("_normal").isNotNull() & ~F.coalesce(column(category).isin(lexicons.CATEGORIES), F.lit(False)) & (F.coalesce(column(category), F.lit("")) != "")
        out = out.withColumn("repaired", F.col("repaired") | other).withColumn(category, F.when(other, F.col("_normal")).otherwise(column(category))).drop("_normal")
    if stance:
        normal = normal_stance(stance)
        other = F.coalesce(normal != column(stance), F.lit(False))
        out = out.withColumn("repaired", F.col("repaired") | other).withColumn(stance, F.when(other, normal).otherwise(column(stance)))
    from .similarity import closest_span

    for span in spans:
        absent = F.coalesce(column(span) != "", F.lit(False)) & ~F.coalesce(F.contains(F.lower(column(text)), F.lower(column(span))), F.lit(False))
        out = out.withColumn("_close", closest_span(F.when(absent, column(span)), F.when(absent, column(text))))
        out = out.withColumn("repaired", F.col("repaired") | F.col("_close").isNotNull()).withColumn(span, F.coalesce("_close", span)).drop("_close")
    return out


def review_checks(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with checks: a line for each field that is not empty, with a tick or a cross."""
    own = rows
    for span, threshold in (("aspect_target", SPAN_F1), ("opinion_span", SPAN_F1), ("explanation", RATIONALE_F1)):
        own = grounding(own, span, text, f"_{span}", threshold)

    def line(name: str, good: Column) -> Column:
        return F.when(~blank(name), F.concat(F.when(good, F.lit("✓ ")).otherwise(F.lit("✗ ")), F.lit(name)))

    lines = [line(s, F.col(f"_{s}")["grounded"]) for s in ("aspect_target", "opinion_span")]
    lines += [line("aspect_category", F.col("aspect_category").isin(lexicons.CATEGORIES)), line("stance", F.col("stance").isin(lexicons.STANCES)), line("explanation", F.col("_explanation")["grounded"])]
    return own.withColumn("checks", F.array_compact(F.array(*lines))).drop("_aspect_target", "_opinion_span", "_explanation")


def error_text(errors: Column | str, prefix: str = "") -> Column:
    """type:field of each error, parted by semicolons."""
    joined = F.array_join(F.transform(column(errors), lambda e: F.concat(e["error_type"], F.lit(":"), e["field"])), "; ")
    return F.concat(F.lit(prefix), joined) if prefix else joined
