"""The numbered queries of this subpackage, each a thin layer over its operator, and plain SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busvitals.llm import toxicity
from busvitals.llm.chat import digests, format_conversations
from busvitals.llm.collocations import collocations
from busvitals.llm.html_content import extract
from busvitals.llm.kneser_ney import quality
from busvitals.llm.line_dedup import keep_bitmaps, kept_texts
from busvitals.llm.lsh_forest import search
from busvitals.llm.mixing import mix
from busvitals.llm.packing import pack
from busvitals.llm.quality_rules import quality_rules
from busvitals.llm.simhash import near_duplicates
from busvitals.llm.suffix_dedup import repeated_passages
from busvitals.llm.text import table, word_count
from busvitals.llm.turn_repair import damaged, repaired_digests
from busvitals.sources.scratch import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its check."""

    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return add


@query("op9_compression_bands")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's base counts and the verdict of the compression bands."""
    return quality_rules(table(spark, folder, "documents"))


@query("op7_concatenate_and_cut")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document in sequences of 1024 tokens."""
    pieces = pack(table(spark, folder, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents
), stats AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY source
), weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM stats
), levels AS (
  SELECT a.*, (SELECT sum(source_size) FROM stats)
      - coalesce((SELECT sum(b.cap) FROM weighed b WHERE b.cap * a.weight <= a.cap * b.weight
          AND (b.cap * a.weight < a.cap * b.weight OR coalesce(b.source, chr(1114111)) < coalesce(a.source, chr(1114111)))), 0) AS rest,
    (SELECT sum(weight) FROM weighed)
      - coalesce((SELECT sum(b.weight) FROM weighed b WHERE b.cap * a.weight <= a.cap * b.weight
          AND (b.cap * a.weight < a.cap * b.weight OR coalesce(b.source, chr(1114111)) < coalesce(a.source, chr(1114111)))), 0) AS among
  FROM weighed a
), level AS (
  SELECT arg_min(rest, cap / weight) AS rest, arg_min(among, cap / weight) AS among FROM levels WHERE cap * among > rest * weight
), plan AS (
  SELECT w.*, w.cap * l.among > l.rest * w.weight AS is_open,
    CASE WHEN w.cap * l.among > l.rest * w.weight THEN l.rest::DOUBLE * w.weight / l.among ELSE w.cap::DOUBLE END AS target,
    CASE WHEN w.source_size = 0 THEN 0 WHEN w.cap * l.among > l.rest * w.weight
      THEN (l.rest::HUGEINT * w.weight * 1000000000000) // (l.among::HUGEINT * w.source_size) ELSE 3000000000000 END AS expected,
    greatest(1, ceil(w.n_docs / greatest(2000.0, 10 * sqrt(w.n_docs))))::BIGINT AS blocks,
    (('0x' || substr(md5('mix|' || coalesce(w.source, chr(0))), 1, 8))::BIGINT * 232) % 1000000000000 AS shift
  FROM weighed w, level l
), placed AS (
  SELECT d.doc_id, d.size, p.*, ('0x' || substr(md5('mix|' || coalesce(d.doc_id, -1)), 1, 8))::BIGINT % p.blocks AS block
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
), summed AS (
  SELECT *, shift + sum(expected) OVER (PARTITION BY source ORDER BY block, CASE WHEN block % 2 = 0 THEN size ELSE -size END,
    coalesce(doc_id, -1) ROWS UNBOUNDED PRECEDING) AS upto FROM placed
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (upto // 1000000000000 - (upto - expected) // 1000000000000))::BIGINT AS taken
FROM summed
"""


@query("op8_systematic_mix", MIX_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(stored(docs, "sizes"), size_col="size").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


TRICKY = r"\### Assistant: </turn> ok"  # a text that looks like the template


@query("op2_budgeted_windows")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, and one more whose texts imitate the markup, formatted and read back."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return digests(format_conversations(given.unionByName(more)))


@query("op3_scored_region")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query("op5_lexicon_automata")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity, learned from the labelled rows that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    learned = docs.join(labels.where(~toxicity.held_out(F.col("doc_id"))), "doc_id")
    return toxicity.score(docs, toxicity.fit(learned)).select("doc_id", "held_out", "score", "predicted")


@query("op6_simhash_bk_trees")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    return near_duplicates(table(spark, folder, "documents"))


@query("op1_interval_expansion")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without its repeated passages."""
    return repeated_passages(table(spark, folder, "documents")).drop("spans")


@query("op10_kneser_ney")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's perplexity under a model of the documents labelled good, and whether it passes its language's limit."""
    trusted = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return quality(table(spark, folder, "documents"), trusted)


@query("op4_prefix_forest")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest found to every fiftieth vector."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


LINES_SQL = r"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS part FROM documents
), lines AS (
  SELECT doc_id, unnest(part) AS line, generate_subscripts(part, 1) AS i FROM parts
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), gone AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(g.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN gone g ON k.key = g.key GROUP BY doc_id
"""


@query("op12_range_partitioned_lines", LINES_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines found in ten documents or more."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return kept_texts(docs, keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


PHRASES_SQL = r"""
WITH plain AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(11) || chr(12) || chr(13) || '.,;:!?', 'abcdefghijklmnopqrstuvwxyz ' || repeat(chr(10), 9)) AS text
  FROM documents
), pieces AS (
  SELECT lang, unnest(string_split(text, chr(10))) AS piece FROM plain
), split AS (
  SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split WHERE len(w) > 0
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM starts, range(1, 6) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, count(*) AS n FROM starts GROUP BY lang
), listed AS (
  SELECT *, string_split(phrase, ' ') AS w FROM grams
), inner_ AS (
  SELECT lang, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase, f FROM listed WHERE k > 2
), covered AS (
  SELECT lang, phrase, max(f) AS most FROM inner_ GROUP BY ALL
), open_ AS (
  SELECT l.* FROM listed l LEFT JOIN covered c USING (lang, phrase) WHERE l.k > 1 AND (c.most IS NULL OR 100 * c.most < 100 * l.f)
), cuts AS (
  SELECT o.lang, o.phrase, o.f AS a, c.j, x.f AS l, y.f AS r, t.n,
    CAST((CAST(1000 AS HUGEINT) * o.f * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM open_ o JOIN range(1, 5) c(j) ON c.j < o.k
  JOIN grams x ON x.lang = o.lang AND x.phrase = array_to_string(o.w[1:c.j], ' ')
  JOIN grams y ON y.lang = o.lang AND y.phrase = array_to_string(o.w[c.j + 1:o.k], ' ')
  JOIN totals t ON t.lang = o.lang
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""


@query("op13_setm_collocations", PHRASES_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Each language's 2,000 most strongly bound phrases."""
    return collocations(table(spark, folder, "documents").select("lang", "text"))


@query("op11_lightest_derivation")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, damaged and put right again: its faults, the cheapest edits, and the hash of what they make."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return repaired_digests(damaged(turns), turns)
