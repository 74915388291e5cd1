"""One query for each operator over its whole table, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm import bit_slices, hard_negatives, lines, mixing, near_copies, neighbours, pages, pieces, pii, quality, repeats, token_store, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


#: Documents that score less are of low quality.
GOOD_FROM = 0.3


def quality_scores(spark: SparkSession, docs: DataFrame, sf_dir: str, name: str = "score") -> DataFrame:
    """``docs`` with ``name``, the score learned from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~held_out())
    return quality.score(docs, quality.train(docs, labels), name)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_texts(docs, tokenizer_path("piece_bpe_32k.model")).drop("text")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op6_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_slices.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_store.store_tokens(docs, tokenizer_path("word_bpe_49k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [F.size(F.filter("_base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *kinds, F.sha2(pii.span_text(F.col("_base")), 256).alias("base_sha256"), pii.span_text(F.col("_spans")).alias("spans"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 8)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_repeat_removal, op2_mix_sources, op3_quality_classifier, op4_piece_encoding, op5_nearest_neighbours, op6_top_products, op7_near_duplicates,
        op8_main_text, op9_token_store, op10_pii, op11_hard_negatives, op12_whitening, op13_line_dedup,
    )
}

ORACLE = {
    "op2_mix_sources": """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM src
), filling AS (
  SELECT *, coalesce(sum(3 * source_size) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS ws,
         sum(source_size) OVER () AS total, sum(w) OVER () AS weights
  FROM ranked
  WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), clamped AS (
  SELECT *, 3 * source_size * (weights - ws) <= w * (total - caps) AS is_full FROM filling
), targets AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE)
         ELSE CAST(w * (total - coalesce(sum(CASE WHEN is_full THEN 3 * source_size END) OVER (), 0)) AS DOUBLE)
              / CAST(weights - coalesce(sum(CASE WHEN is_full THEN w END) OVER (), 0) AS DOUBLE) END AS target
  FROM clamped
), drawn AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST((whole + CASE WHEN size > 0 AND start + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM drawn
""",
    "op5_nearest_neighbours": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding::DOUBLE[] if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding::DOUBLE[] if x <> 0]) > 0
), pairs AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.n <> c.n WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op6_top_products": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, [floor(256 * x) for x in embedding::DOUBLE[]] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding::DOUBLE[] if x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.n <> c.n WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x) for x in embedding::DOUBLE[]] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding::DOUBLE[] if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.n, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.n <> b.n WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS place FROM scored WHERE same
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.n, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON p.n = s.n AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
  WHERE p.place <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
""",
    "op13_line_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT n, doc, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT n, doc, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(doc) AS first FROM k WHERE length(key) >= 10 GROUP BY key
), t AS (
  SELECT k.n, count(*) AS n_lines, count(*) FILTER (WHERE k.doc > f.first) AS n_dropped,
         coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.first IS NULL OR k.doc <= f.first), '') AS kept
  FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.n
)
SELECT d.doc_id, t.n_lines, t.n_dropped, sha256(t.kept) AS kept_sha256 FROM t JOIN d USING (n)
""",
}
