"""Readers and writers: CSV, text, JSON lines, statistics, page and profile lookups, routed results, state."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.routing import RESULT_COLUMNS


def all_text(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: list[str], *, line_ends: bool = True) -> DataFrame:
    """A CSV file with a header as text columns; null becomes empty.  Quoted fields may hold line ends; where they do not,
    line_ends=False lets large files be split between tasks, else a file is one task."""
    return spark.read.schema(all_text(columns)).option("header", True).option("multiLine", line_ends).option("escape", '"').csv(path).na.fill("")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_results(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A result file, or a table without rows where there is none."""
    columns = columns or RESULT_COLUMNS
    return read_csv(spark, path, columns) if exists(spark, path) else spark.createDataFrame([], all_text(columns))


def read_predictions_input(spark: SparkSession, path: str, *, line_ends: bool = True) -> DataFrame:
    """A CSV file that has a column text, null as empty; all columns are read as text, so the file is read once."""
    rows = spark.read.option("header", True).option("multiLine", line_ends).option("escape", '"').csv(path)
    if "text" not in rows.columns:
        raise ValueError("the input has no column text")
    return rows.withColumn("text", F.coalesce(F.col("text"), F.lit("")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, or of the .txt files of a folder."""
    return spark.read.option("pathGlobFilter", "*.txt").text(path) if not path.endswith(".txt") else spark.read.text(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def seeded_subset(rows: DataFrame, n: int, *, key: str, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash of a key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    """(n, gram, cnt) from lines of words and a count, parted by tabs."""
    parts = F.split("value", "\t")
    size = F.size("p")
    return spark.read.text(path).select(parts.alias("p")).filter(size > 1).select((size - 1).alias("n"), F.array_join(F.slice("p", F.lit(1), size - 1), "_").alias("gram"), F.try_element_at("p", size).cast("long").alias("cnt"))


def write_ngrams(counts: DataFrame, path: str) -> None:
    """Lines of words and a count, parted by tabs."""
    counts.select(F.concat(F.translate("gram", "_", "\t"), F.lit("\t"), F.col("cnt").cast("string")).alias("value")).write.mode("overwrite").text(path)


def read_emotions(spark: SparkSession, path: str) -> DataFrame:
    """(word, emotion, score) from three tab-parted columns."""
    return spark.read.schema("word string, emotion string, score double").option("sep", "\t").csv(path)


def cached(spark: SparkSession, path: str, make) -> DataFrame:  # noqa: ANN001
    """The table at a path, made and written there first if it is not there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)


class _Gist(HTMLParser):
    """Title and first paragraph of more than 30 characters."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.first, self.inside, self.parts = "", "", "", []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("title", "p"):
            self.end()
            self.inside = tag

    def handle_endtag(self, tag: str) -> None:
        if tag == self.inside or tag in ("body", "html"):
            self.end()

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.parts.append(data)

    def end(self) -> None:
        text = "".join(x.strip() for x in self.parts) if self.inside == "p" else "".join(self.parts).strip()
        if self.inside == "title" and not self.title:
            self.title = text
        elif self.inside == "p" and not self.first and len(text) > 30:
            self.first = text[:200]
        self.inside, self.parts = "", []


def gist(html: str | None) -> str:
    if not html:
        return ""
    parser = _Gist()
    try:
        parser.feed(html)
        parser.close()
        parser.end()
    except AssertionError:
        return ""
    return " ".join(x for x in (parser.title, parser.first) if x)


@F.pandas_udf(T.StringType())
def page_gist(html: pd.Series) -> pd.Series:
    """Title and beginning of a page; empty for what cannot be read."""
    return html.map(gist)


def get_url(url: str, *, seconds: float = 10.0, most: int = 1 << 20) -> str:
    """The body of a page, at most so many bytes of it, as text."""
    with urllib.request.urlopen(url, timeout=seconds) as answer:  # noqa: S310  the caller chooses the links
        return answer.read(most).decode(answer.headers.get_content_charset() or "utf-8", "replace")


def fetched(keys: DataFrame, key: str, out: str, get: Callable[[str], str] = get_url) -> DataFrame:
    """key and out, what get() returns for each distinct key; null for what it fails on.  Pages come by their links with
    get_url; profiles by their handles with a function that asks a service for a name."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for x in frame[key]:
                try:
                    found.append(get(x))
                except Exception:  # noqa: BLE001  whatever goes wrong, the answer is missing
                    found.append(None)
            yield pd.DataFrame({key: frame[key], out: pd.Series(found, index=frame.index, dtype="object")})

    return keys.select(F.col(key).cast("string").alias(key)).filter(F.col(key).isNotNull()).distinct().mapInPandas(run, f"`{key}` string, `{out}` string")


def read_dictionary(spark: SparkSession, path: str, *, most: int = 100_000) -> dict[str, str]:
    """A dictionary of tab-parted words and meanings, such as one of slang; lines without a meaning are left out."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == 2).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} words")
    return {r["p"][0]: r["p"][1] for r in rows}


def resolve_links(rows: DataFrame, pages: DataFrame, *, text: str = "text", key: str = "row_idx", least: float = 0.3, keywords: list[str] | None = None) -> DataFrame:
    """rows with important links replaced by the gist of their page in brackets, and all others deleted.

    pages: url and html, as a fetcher wrote them.  Links are resolved once each and joined back by row.
    """
    from ..functions.cleaning import drop_links, link_importance, links

    found = rows.select(key, F.col(text).alias("_t"), F.explode(F.array_distinct(links(text))).alias("_url")).filter(link_importance("_url", "_t", keywords) >= least)
    wanted = found.select("_url").distinct().join(pages.select(F.col("url").alias("_url"), "html"), "_url")
    known = wanted.dropDuplicates(["_url"]).select("_url", page_gist("html").alias("_gist")).filter("_gist <> ''")
    each = found.select(key, "_url").join(known, "_url").groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_list(F.struct((-F.length("_url")).alias("l"), "_url", "_gist"))).alias("_known"))
    joined = rows.join(each, F.col(key) == F.col("_k"), "left")
    # an opened link must not be read as a link again
    filled = F.aggregate(F.coalesce("_known", F.array().cast("array<struct<l:int,_url:string,_gist:string>>")), F.col(text), lambda t, x: F.replace(t, x["_url"], F.concat(F.lit("["), x["_gist"], F.lit("]"))))
    return joined.withColumn(text, drop_links(filled)).drop("_k", "_known")


def resolve_mentions(rows: DataFrame, profiles: DataFrame, *, text: str = "text", key: str = "row_idx") -> DataFrame:
    """rows with @handles replaced by the names in profiles (handle, name), or left as they are."""
    handles = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(?U)@\w+"), F.lit(0)))
    found = rows.select(key, F.explode(handles).alias("_h")).join(profiles.select(F.concat(F.lit("@"), F.regexp_replace("handle", "^@", "")).alias("_h"), "name"), "_h")
    each = found.groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_list(F.struct((-F.length("_h")).alias("l"), "_h", "name"))).alias("_known"))
    joined = rows.join(each, F.col(key) == F.col("_k"), "left")
    filled = F.aggregate(F.coalesce("_known", F.array().cast("array<struct<l:int,_h:string,name:string>>")), F.col(text), lambda t, x: F.replace(t, x["_h"], x["name"]))
    return joined.withColumn(text, filled).drop("_k", "_known")


def write_routed(rows: DataFrame, folder: str, *, status: str = "status", mode: str = "append") -> None:
    """Accepted, repaired and review rows as CSV, a folder for each status; other rows are not written."""
    kept = rows.filter(F.col(status).isin("accepted", "repaired", "review")).withColumn("_route", F.col(status))
    kept.write.mode(mode).partitionBy("_route").option("header", True).option("escape", '"').csv(folder)


def write_final(rows: DataFrame, path: str) -> None:
    """One CSV file; the final data are bounded by the quotas."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def save_state(rows: DataFrame, path: str, *, key: Column, text_key: Column, label: str = "stance", cost: str = "cost_usd") -> None:
    """What a later run needs of processed rows: keys, hashes of emitted texts, labels and costs."""
    rows.select(key.alias("key"), text_key.alias("text_hash"), F.col(label).alias("label"), F.col(cost).cast("double").alias("cost"), F.col("status")).write.mode("append").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    schema = "key string, text_hash string, label string, cost double, status string"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def state_summary(state: DataFrame) -> DataFrame:
    """Emitted rows by label, and the cost of all rows."""
    return state.groupBy("label").agg(F.count_if(F.col("status").isin("accepted", "repaired")).alias("emitted"), F.sum("cost").alias("cost"))


def batches(rows: DataFrame, size: int) -> Iterator[DataFrame]:
    """Spans of row_idx, for processing that may stop early."""
    last = rows.agg(F.max("row_idx")).first()[0]
    for at in range(0, (last if last is not None else -1) + 1, size):
        yield rows.filter((F.col("row_idx") >= at) & (F.col("row_idx") < at + size))
