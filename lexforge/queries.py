"""Registered queries: each operator over the driver's whole tables, with SQL of the same rows where SQL has it.

The tables have no posts about housing, so keyword lists, sources and labels are given here as parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import cleaning, judgment, patterns, validation
from .functions.similarity import plainly_grounded, token_f1
from .functions.strings import squeeze, text_key
from .operators import generation, ngram_stats, relational, routing, semantic, social
from .plans.pipelines import Selection, candidates
from .sources.io import page_gist

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KEYWORDS = ["the", "with", "und", "que", "password"]
PHRASES = ["of the", "in the", "de la"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- filters, membership, duplicates ---------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3')")
def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.source_filter(table(spark, sf_dir, "documents"), ["src0", "src1", "src2", "src3"]).select("doc_id", "source")


_HITS = "len(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda x: x IN ('the', 'with', 'und', 'que', 'password')))"


@query(f"SELECT doc_id, {_HITS}::INTEGER AS hits FROM documents WHERE {_HITS} >= 1")
def keyword_filter_min1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.keyword_filter(table(spark, sf_dir, "documents"), KEYWORDS)
    return rows.select("doc_id", relational.keyword_hits("text", KEYWORDS).alias("hits"))


@query(f"SELECT doc_id FROM documents WHERE {_HITS} >= 3")
def keyword_filter_min3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.keyword_filter(table(spark, sf_dir, "documents"), KEYWORDS, least=3).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(' ' || array_to_string(list_transform(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}_ ]'), lambda x: ' ' || x || ' '), '|') || ' ', '[^\\p{L}\\p{M}\\p{N}_](of the|in the|de la)[^\\p{L}\\p{M}\\p{N}_]')")
def keyword_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.keyword_filter(table(spark, sf_dir, "documents"), PHRASES).select("doc_id")


_STRIP = "lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))"


@query(f"""SELECT doc_id FROM documents WHERE sha256({_STRIP.format("text")}) NOT IN (SELECT sha256({_STRIP.format("text")}) FROM documents JOIN labels USING (doc_id) WHERE quality = 0)""")
def gold_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    gold = docs.join(labels.filter("quality = 0"), "doc_id")
    return relational.without_known(docs, gold).select("doc_id")


@query("SELECT doc_id FROM documents WHERE concat(source, '_', doc_id) NOT IN (SELECT concat(source, '_', doc_id) FROM documents JOIN labels USING (doc_id))")
def processed_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    state = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(F.concat_ws("_", "source", "doc_id").alias("key"))
    return relational.without_processed(docs, state, F.concat_ws("_", "source", "doc_id")).select("doc_id")


@query(f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256({_STRIP.format("text")}) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def exact_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY list_sort(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''))) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def token_set_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.token_set_dedup(table(spark, sf_dir, "documents")).select("doc_id")


@query()
def fuzzy_dedup_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.fuzzy_dedup(table(spark, sf_dir, "documents"), 0.8).select("doc_id")


@query("WITH r AS (SELECT label, arg_min(embedding::DOUBLE[], vec_id) AS v FROM embeddings GROUP BY label), s AS (SELECT vec_id, max(list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v)) + 1e-8)) AS m FROM embeddings, r GROUP BY vec_id) SELECT vec_id, round(m, 5) AS similarity FROM s WHERE m >= 0.35")
def semantic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    # one stated reference for each label
    references = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).collect()
    scored = semantic.best_similarity(vectors, [list(map(float, r["v"])) for r in references])
    return scored.filter("similarity >= 0.35").select("vec_id", F.round("similarity", 5).alias("similarity"))


# --- labels and samples ----------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE upper(trim(event_type)) WHEN 'FAVOR' THEN 'HOPEFUL' WHEN 'AGAINST' THEN 'HATE' ELSE 'NEUTRAL' END AS stance FROM events")
def source_stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", validation.source_stance("event_type").alias("stance"))


_U = "((CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) + 1) / 4294967296.0::DOUBLE)"


@query(f"SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY -ln({_U}) / (CASE WHEN lang = 'en' THEN 2.0 ELSE 1.0 END), doc_id) AS r FROM documents JOIN labels USING (doc_id)) WHERE r <= 30")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    weight = F.when(F.col("lang") == "en", 2.0).otherwise(1.0)
    return relational.balanced_sample(rows, label="toxic", per_class=30, weight=weight).select("doc_id", "toxic")


@query(f"""WITH d AS (SELECT doc_id, lang, {_U} AS u FROM documents), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY u, doc_id) AS r FROM d WHERE lang IN ('de', 'en', 'fr')) WHERE r = 1),
  o AS (SELECT doc_id, lang, u FROM d WHERE doc_id NOT IN (SELECT doc_id FROM f) ORDER BY u, doc_id LIMIT 5), a AS (SELECT doc_id, lang, u, 0 AS late FROM f UNION ALL SELECT doc_id, lang, u, 1 FROM o) SELECT doc_id, lang FROM a ORDER BY late, u, doc_id LIMIT 5""")
def few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.few_shot(table(spark, sf_dir, "documents"), label="lang", labels=["de", "en", "fr"], n=5).select("doc_id", "lang")


@query("WITH c AS (SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source) SELECT dimension, value, n, round(100.0 * n / sum(n) OVER (PARTITION BY dimension), 6)::DOUBLE AS percent FROM c")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.distribution(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT count(*) AS rows, count_if(trim(event_type) <> '' AND trim(props) <> '')::BIGINT AS complete, count_if(trim(event_type) <> '' AND trim(props) <> '' AND event_type IN ('click', 'view'))::BIGINT AS in_category, count_if(trim(event_type) <> '' AND trim(props) <> '' AND event_type IN ('click', 'view') AND event_type = 'click')::BIGINT AS in_stance FROM events")
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.gate_counts(table(spark, sf_dir, "events"), ["event_type", "props"], category="event_type", stance="event_type", categories=["click", "view"], stances=["click"])


# --- cleaning ---------------------------------------------------------------------------------------------------------


def _cleaned(name: str, f: Callable, sql: str | None, source: str = "documents", key: str = "doc_id", text: str = "text") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, F.md5(f(text)).alias("digest"))

    run.__name__ = name
    query(f"SELECT {key}, md5({sql}) AS digest FROM {source}" if sql else None)(run)


_cleaned("clean_links", cleaning.drop_links, "regexp_replace(url, 'https?://[^\\s<>\"'']+|www\\.[^\\s<>\"'']+', '', 'gi')", "pages", "page_id", "url")
_cleaned("clean_mentions", cleaning.drop_mentions, "regexp_replace(text, '@[\\p{L}\\p{M}\\p{N}_]+', '', 'g')")
_cleaned("clean_hash_signs", cleaning.drop_hash_signs, "regexp_replace(text, '#([\\p{L}\\p{M}\\p{N}_]+)', '\\1', 'g')")
_cleaned("clean_controls", cleaning.drop_controls, "regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f\\p{Cf}\\p{Co}]', '', 'g')", "conversations", "conv_id")
_cleaned("clean_punctuation", cleaning.squeeze_punctuation, "regexp_replace(text, '([!?.]){2,}', '\\1', 'g')")
_cleaned("clean_white_space", squeeze, "regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g')")
_cleaned("clean_abbreviations", lambda c: cleaning.expand_abbreviations(c, {"the": "that which", "und": "and"}, {"de": "of"}), "array_to_string(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), lambda t: CASE regexp_replace(lower(t), '^[.,!?;:()]+|[.,!?;:()]+$', '', 'g') WHEN 'the' THEN 'that which' WHEN 'und' THEN 'and' WHEN 'de' THEN 'of' ELSE t END), ' ')")
_cleaned("unique_sentences", cleaning.unique_sentences, "(SELECT array_to_string(list_filter(p, lambda s, i: list_position(k, k[i]) = i), ' ') FROM (SELECT p, list_transform(p, lambda s: lower(regexp_replace(s, '^\\s+|\\s+$', '', 'g'))) AS k FROM (SELECT string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p)))")



@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '^\\s*(\\[([dD][eE][lL][eE][tT][eE][dD]|[rR][eE][mM][oO][vV][eE][dD])\\]\\s*)?$') AND length(text) >= 20")
def usable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.filter(~cleaning.empty_or_deleted("text") & cleaning.long_enough("text")).select("doc_id")


@query("SELECT doc_id, len(regexp_extract_all(text, '@[\\p{L}\\p{M}\\p{N}_]+'))::INTEGER AS users, len(regexp_extract_all(text, '#[\\p{L}\\p{N}_][\\p{L}\\p{M}\\p{N}_-]*[\\p{L}\\p{M}\\p{N}_]|#[\\p{L}\\p{N}_]'))::INTEGER AS hashtags FROM documents")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", patterns.entity_count("text", "user").alias("users"), patterns.entity_count("text", "hashtag").alias("hashtags"))


@query()
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("email", "phone", "date", "time", "money", "percent", "url")
    return table(spark, sf_dir, "documents").select("doc_id", *[patterns.entity_count("text", n).alias(n) for n in names])





# --- n-grams ----------------------------------------------------------------------------------------------------------

_WORDS = "list_filter(string_split_regex(regexp_replace(lower(line), '[#@][\\p{L}\\p{M}\\p{N}_]+', ' ', 'g'), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{1,15}'))"
_GRAMS = f"""WITH l AS (SELECT unnest(string_split(regexp_replace(text, 'https?://(www\\.)?[^\\s.]+\\.[^\\s]{{2,}}|www\\.[^\\s]+\\.[^\\s]{{2,}}', ' ', 'g'), chr(10))) AS line FROM documents), w AS (SELECT {_WORDS} AS w FROM l),
  p AS (SELECT w, list_prepend('<S>', w) AS b FROM w), g AS (SELECT 1 AS n, unnest(w) AS gram FROM p UNION ALL SELECT 2, unnest(list_transform(range(1, len(b)), lambda i: b[i] || '_' || b[i + 1])) FROM p), c AS (SELECT n, gram, count(*) AS cnt FROM g GROUP BY n, gram)"""


@query(f"{_GRAMS} SELECT n, gram, cnt FROM c")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_stats.count_ngrams(table(spark, sf_dir, "documents"))


@query(f"{_GRAMS} SELECT n, gram, cnt FROM c WHERE cnt >= CASE n WHEN 1 THEN 60 ELSE 25 END")
def ngram_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_stats.frequent_ngrams(ngram_stats.count_ngrams(table(spark, sf_dir, "documents")))


@query(f"{_GRAMS}, q AS (SELECT n, quantile_cont(cnt, 0.95) AS cut FROM c GROUP BY n) SELECT n, gram, cnt FROM c JOIN q USING (n) WHERE cnt >= greatest(cut, 3)")
def ngram_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_stats.frequent_ngrams(ngram_stats.count_ngrams(table(spark, sf_dir, "documents")), {1: 3, 2: 3}, 95)


@query(f"{_GRAMS} SELECT gram, round(cnt / sum(cnt) OVER (), 9)::DOUBLE AS p FROM c WHERE n = 1")
def word_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ngram_stats.count_ngrams(table(spark, sf_dir, "documents"), most=1)
    return ngram_stats.probabilities(counts).select("gram", F.round("p", 9).alias("p"))


# --- spans and annotations ---------------------------------------------------------------------------------------------

_NEXT = "SELECT conv_id, turn, text AS span, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS post FROM conversations"
_SET = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda x: x <> ''))"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("span"), F.lead("text").over(after).alias("post"))
    return rows.filter("post is not null")


@query(f"""WITH s AS ({_NEXT}), t AS (SELECT conv_id, turn, {_SET.format("span")} AS a, {_SET.format("post")} AS b FROM s WHERE post IS NOT NULL), c AS (SELECT conv_id, turn, len(list_intersect(a, b)) AS k, len(a) AS x, len(b) AS y FROM t)
  SELECT conv_id, turn, CASE WHEN k > 0 THEN round(2.0 * (k / x) * (k / y) / (k / x + k / y), 9) ELSE 0.0 END::DOUBLE AS f1 FROM c""")
def span_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("conv_id", "turn", F.round(token_f1("span", "post"), 9).alias("f1"))


@query(f"""WITH s AS ({_NEXT}), t AS (SELECT conv_id, turn, span, post, {_SET.format("span")} AS a, {_SET.format("post")} AS b FROM s WHERE post IS NOT NULL), c AS (SELECT *, len(list_intersect(a, b)) AS k FROM t)
  SELECT conv_id, turn, span <> '' AND post <> '' AND (contains({_STRIP.format("post")}, {_STRIP.format("span")}) OR (k > 0 AND 2.0 * (k / len(a)) * (k / len(b)) / (k / len(a) + k / len(b)) >= 0.6)) AS grounded FROM c""")
def span_grounded_plainly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("conv_id", "turn", plainly_grounded("span", "post", 0.6).alias("grounded"))


@query("SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN p_type WHEN lower(p_type) = 'standard' THEN 'Standard' END AS category FROM (SELECT p_partkey, split_part(p_type, ' ', 1) AS p_type FROM part)")
def plain_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", validation.known_category(F.split("p_type", " ")[0], ["ECONOMY", "PROMO", "Standard"], {"none": "PROMO"}).alias("category"))



@query("SELECT event_id, CASE WHEN upper(event_type) IN ('CLICK', 'VIEW') THEN upper(event_type) WHEN lower(event_type) = 'purchase' THEN 'CLICK' END AS label FROM events")
def normal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", validation.normal_stance("event_type", ["CLICK", "VIEW"], {"purchase": "CLICK"}).alias("label"))


_HOSTILE = "(SELECT bool_or(contains(lower(text), m)) FROM (SELECT unnest(['kicked out', 'ruining', 'disgusting', 'get rid', 'remove', 'forced out', 'destroy', 'trash', 'filth', 'vermin', 'scum']) AS m))"
_KIND = "(SELECT bool_or(contains(lower(text), m)) FROM (SELECT unnest(['invest', 'support', 'help', 'expand', 'improve', 'should be', 'need more', 'deserve', 'dignity', 'compassion', 'solution']) AS m))"


@query(f"SELECT doc_id, NOT ((toxic = 1 AND {_KIND} AND NOT {_HOSTILE}) OR (toxic = 0 AND {_HOSTILE} AND NOT {_KIND})) AS consistent FROM documents JOIN labels USING (doc_id)")
def label_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", validation.consistent(F.when(F.col("toxic") == 1, "HATE").otherwise("HOPEFUL"), "text").alias("consistent"))


@query("SELECT event_id, CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN json_extract_string(props, '$.k') END AS k FROM events")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(validation.parse_object("props")["json"], "$.k").alias("k"))


@query()
def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("row_idx", F.col("conv_id") * 1000 + F.col("turn"))
    done = generation.process(turns, generation.RuleBackend())
    return done.select("conv_id", "turn", "status", "stance", "aspect_category", "cost_usd", "errors")


# --- costs, routing, merge ---------------------------------------------------------------------------------------------

_TOKENS = "len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))"


@query(f"WITH t AS (SELECT role AS stage, {_TOKENS} AS i, length(text) AS o FROM conversations) SELECT stage, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, round(sum(i / 1000.0 * 0.0004 + o / 1000.0 * 0.0016)::DOUBLE, 6) AS cost_usd FROM t GROUP BY ROLLUP (stage)")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.strings import words

    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("stage"), F.size(words("text")).cast("long").alias("tokens_in"), F.char_length("text").cast("long").alias("tokens_out"))
    return generation.cost_summary(rows).withColumn("cost_usd", F.round("cost_usd", 6))


@query("SELECT event_id, sum(round(value * 100)::BIGINT) OVER (ORDER BY event_id)::BIGINT AS cents FROM events")
def running_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return relational.running_total(rows, F.round(F.col("value") * 100).cast("long"), "event_id", "cents").select("event_id", F.col("cents").cast("long").alias("cents"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY event_id) AS so_far FROM events")
def class_counts_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.running_counts(table(spark, sf_dir, "events"), "event_type", "event_id").select("event_id", "so_far")


@query("""WITH e AS (SELECT event_id, event_type, user_id, round(value * 100)::BIGINT AS c FROM events), s AS (SELECT *, sum(c) OVER (ORDER BY event_id) - c AS before FROM e), t AS (SELECT * FROM s WHERE before < 500000),
  f AS (SELECT event_type, user_id, min(event_id) AS event_id FROM t WHERE event_type <> 'error' GROUP BY event_type, user_id), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM f), g AS (SELECT * FROM r WHERE k <= 40 AND event_type IN ('click', 'purchase', 'view')),
  stop AS (SELECT CASE WHEN count(*) = 120 THEN max(event_id) ELSE 4611686018427387904 END AS last FROM g), o AS (SELECT event_id, 1 AS q FROM g UNION ALL SELECT event_id, 0 FROM t WHERE event_type = 'error')
  SELECT event_id, (sum(q) OVER (ORDER BY event_id) - q + 1)::BIGINT AS sample_id FROM o, stop WHERE event_id <= last""")
def quota_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_type") == "error", "review").otherwise("accepted").alias("status"), F.concat_ws(":", "event_type", "user_id").alias("key"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    routed = routing.quota_route(rows, order="event_id", status="status", label="event_type", key="key", cost="cents", quotas={"click": 40, "purchase": 40, "view": 40}, budget=500000)
    return routed.select("event_id", F.col("sample_id").cast("long").alias("sample_id"))


def _results(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    full = rows.select(
        F.col("doc_id").alias("sample_id"), F.col("text").alias("cleaned_text"), F.col("text").alias("aspect_target"), F.lit("Public Space").alias("aspect_category"),
        F.col("text").alias("opinion_span"), F.when(F.col("toxic") == 1, "HATE").when(F.col("quality") == 1, "HOPEFUL").otherwise("Neutral").alias("stance"), F.col("text").alias("explanation"), "lang",
    )
    return [full.filter("lang = 'en'").drop("lang"), full.filter("lang = 'de'").drop("lang"), full.filter("lang not in ('en', 'de')").drop("lang")]


@query("""WITH r AS (SELECT doc_id, text, CASE WHEN toxic = 1 THEN 'HATE' WHEN quality = 1 THEN 'HOPEFUL' ELSE 'Neutral' END AS stance, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS part FROM documents JOIN labels USING (doc_id))
  SELECT row_number() OVER (ORDER BY part, doc_id) AS sample_id, md5(text) AS digest, stance FROM r WHERE stance <> 'Neutral' AND regexp_matches(text, '\\S')""")
def merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.merge(_results(spark, sf_dir)).select("sample_id", F.md5("text").alias("digest"), "stance")


@query("""WITH r AS (SELECT CASE WHEN toxic = 1 THEN 'HATE' WHEN quality = 1 THEN 'HOPEFUL' ELSE 'Neutral' END AS stance FROM documents JOIN labels USING (doc_id) WHERE regexp_matches(text, '\\S')), k AS (SELECT * FROM r WHERE stance <> 'Neutral'),
  c AS (SELECT 'stance' AS dimension, stance AS value, count(*) AS n FROM k GROUP BY stance UNION ALL SELECT 'aspect_category', 'Public Space', count(*) FROM k) SELECT dimension, value, n, round(100.0 * n / sum(n) OVER (PARTITION BY dimension), 6)::DOUBLE AS percent FROM c""")
def merge_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.summary(routing.merge(_results(spark, sf_dir)))


# --- judgment distributions --------------------------------------------------------------------------------------------

# each half of a vector gives a distribution over five labels: the label of a component is its place modulo five
_SHARES = "list_transform(range(0, 5), lambda i: list_sum(list_transform(list_filter({0}, lambda x, j: (j - 1) % 5 = i), lambda x: abs(x::DOUBLE))) / list_sum(list_transform({0}, lambda x: abs(x::DOUBLE))))"
_P = f"SELECT vec_id, {_SHARES.format('embedding[1:32]')} AS p, {_SHARES.format('embedding[33:64]')} AS q FROM embeddings"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    def share(start: int):  # noqa: ANN202
        part = F.transform(F.slice("embedding", start, 32), lambda x: F.abs(x.cast("double")))
        return F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: judgment.total(F.filter(part, lambda _, j: j % 5 == i)) / judgment.total(part))

    return table(spark, sf_dir, "embeddings").select("vec_id", share(1).alias("p"), share(33).alias("q"))


_MEAN = "list_sum(list_transform(range(1, 6), lambda i: (i - 1) / 4.0::DOUBLE * {0}[i]))"
_CUM = "list_transform(range(1, 6), lambda i: list_sum({0}[1:i]))"


@query(f"WITH d AS ({_P}) SELECT vec_id, round({_MEAN.format('p')}, 6)::DOUBLE AS mean, ((list_position(p, list_max(p)) - 1) / 4.0)::DOUBLE AS mode FROM d")
def judge_mean_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("vec_id", F.round(judgment.mean("p"), 6).alias("mean"), judgment.mode("p").alias("mode"))


@query(f"WITH d AS ({_P}), c AS (SELECT vec_id, {_CUM.format('p')} AS c FROM d) SELECT vec_id, ((len(list_filter(c, lambda x: x <= 0.5))) / 4.0)::DOUBLE AS median, ((len(list_filter(c, lambda x: x <= 0.01))) / 4.0)::DOUBLE AS lowest FROM c")
def judge_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("vec_id", judgment.median("p").alias("median"), judgment.lower_percentile("p").alias("lowest"))


@query(f"WITH d AS ({_P}), c AS (SELECT vec_id, p, q, {_CUM.format('p')} AS c FROM d) SELECT vec_id, round(1 - 2 * list_dot_product(c, q) + list_dot_product(p, q), 6)::DOUBLE AS superiority, sign({_MEAN.format('p')} - {_MEAN.format('q')})::DOUBLE AS lead FROM c")
def judge_superiority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("vec_id", F.round(judgment.superiority("p", "q"), 6).alias("superiority"), F.signum(judgment.mean("p") - judgment.mean("q")).alias("lead"))


@query(f"""WITH d AS ({_P}), x AS (SELECT vec_id, unnest(range(1, 6)) AS i, p, q FROM d), y AS (SELECT vec_id, i, unnest(range(1, 6)) AS j, p, q FROM x), z AS (SELECT vec_id, p[i] * q[j] AS w, (i - j) / 4.0::DOUBLE AS g FROM y), m AS (SELECT vec_id, sum(w * g) AS e, sum(w * abs(g)) AS a, sum(w * g * g) AS s FROM z GROUP BY vec_id)
  SELECT vec_id, round(CASE WHEN a + sqrt(greatest(s - e * e, 0)) > 1e-3 THEN e / (a + sqrt(greatest(s - e * e, 0))) ELSE 0 END, 6)::DOUBLE AS lead FROM m""")
def judge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("vec_id", F.round(judgment.compare_means("p", "q"), 6).alias("lead"))




# --- plans --------------------------------------------------------------------------------------------------------------


def _candidates_sql() -> str:
    key = _STRIP.format("text")
    u = "((CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) + 1) / 4294967296.0::DOUBLE)"
    return f"""WITH k AS (SELECT doc_id, text, lang, source FROM documents WHERE {_HITS} >= 1), g AS (SELECT doc_id, text, lang, source FROM k WHERE sha256({key}) NOT IN (SELECT sha256({key}) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)),
      f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY list_sort(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''))) ORDER BY doc_id) AS r FROM g) WHERE r = 1),
      m AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'HOPEFUL' WHEN 'de' THEN 'HATE' ELSE 'NEUTRAL' END AS mapped_stance, CASE WHEN source = 'src0' THEN 2.0 ELSE 1.0 END AS w FROM f)
      SELECT doc_id, mapped_stance FROM (SELECT *, row_number() OVER (PARTITION BY mapped_stance ORDER BY -ln({u}) / w, doc_id) AS n FROM m) WHERE n <= 100"""


@query(_candidates_sql())
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("stance", F.when(F.col("lang") == "en", "favor").when(F.col("lang") == "de", "Against").otherwise("none"))
    gold = docs.join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id")
    chosen = Selection(sources=(), keywords=tuple(KEYWORDS), weights={"src0": 2.0}, per_class=100)
    return candidates(docs, gold, chosen, source="source", order="doc_id").select("doc_id", "mapped_stance")


from . import examples  # noqa: E402, F401  registers its queries

__all__ = ["QUERIES", "SQL", "Query", "query", "table", "text_key"]
