"""Registered queries of the training-data operators: ``QUERIES`` and ``ORACLES``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (align, ann, collocations, decontaminate, html_extract, mixing, near_dedup, packing, quality,
               suffix_dedup, token_output, toxicity, url_filter)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark contamination of every document."""
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), "contaminated")


_WORDS_SQL = (r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLES["op10_decontamination"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS_SQL.format('text')}, []) AS ws FROM documents),
b AS (SELECT item_id, {_WORDS_SQL.format('text')} AS ws FROM benchmark),
s AS (SELECT DISTINCT item_id, m, array_to_string(ws[i : i + m - 1], ' ') AS span
      FROM (SELECT item_id, ws, least(13, len(ws)) AS m, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i
            FROM b WHERE len(ws) > 0)),
w AS (SELECT r, m, i, array_to_string(ws[i : i + m - 1], ' ') AS span
      FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM s) WHERE len(ws) >= m)),
h AS (SELECT r, i, s.m, item_id FROM w JOIN s ON w.m = s.m AND w.span = s.span),
p AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS pos FROM h) GROUP BY r),
n AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM h GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN n USING (r)
"""


@_query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id",
                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@_query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    m = mixing.mix(docs)
    return m.select("row.doc_id", "mix.size", "mix.source_size", "mix.target",
                    (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


ORACLES["op1_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), text)), 1, 8) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / w AS ratio FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (
             ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), w * max(CASE WHEN level <= ratio THEN level END) OVER ()) AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS passes FROM t),
b AS (
  SELECT d.source, h, sum(size) AS words, any_value(target - passes * source_size) AS rest
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source GROUP BY d.source, h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM b),
e AS (
  SELECT source, min(h) AS edge, arg_min(2 * (rest - (upto - words)) > words, h) AS nearer
  FROM c WHERE upto > rest GROUP BY source)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN h < edge OR (h = edge AND nearer) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_default(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@_query
def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and checksums of every document, read back from the token files."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_output.round_trip(docs, tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


@_query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings removed from every document."""
    kept = suffix_dedup.without_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@_query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_extract.extract(_read(spark, sf_dir, "pages"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    outcomes = url_filter.page_outcomes(pages)
    return url_filter.judge(pages.select("page_id", "url"), outcomes).select("row.page_id", "host", "path", "rule", "verdict", "bad_rate", "bound")


@_query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; ``kept`` where it is at least one half."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.learn(docs))
    return scored.select("row.doc_id", "score", (F.col("score") >= quality.KEEP).alias("kept"))


@_query
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


@_query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned on every document, and how common the id pairs they link are."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return align.align(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


@_query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


@_query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best-scoring phrases."""
    return collocations.collocations(_read(spark, sf_dir, "documents").select("lang", "text"))


ORACLES["op13_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT *, unnest(range(1, k)) AS m FROM c),
scored AS (
  SELECT cut.lang, cut.k, cut.phrase, cut.a, cut.m, x.a AS l, y.a AS r,
         CAST(2000000 * CAST(cut.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.k = cut.m AND x.phrase = array_to_string(cut.ws[:cut.m], ' ')
  JOIN f y ON y.lang = cut.lang AND y.k = cut.k - cut.m AND y.phrase = array_to_string(cut.ws[cut.m + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, m) = 1),
part AS (
  SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m:
         list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))))) AS phrase
  FROM c),
around AS (SELECT lang, phrase, max(a) AS most FROM part GROUP BY ALL),
stay AS (
  SELECT best.* FROM best LEFT JOIN around ON around.lang = best.lang AND around.phrase = best.phrase
  WHERE most IS NULL OR 100 * most < 80 * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
