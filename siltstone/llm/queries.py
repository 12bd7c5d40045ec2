"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import alignment, bpe, chat, cross_polytope, html_density, minhash, mixing, norm_buckets, pii, suffix_dedup, super_kmers, toxicity, vafile
from siltstone.llm.common import table
from siltstone.llm.oracles import OP1_SQL, OP2_SQL, OP10_SQL, OP12_SQL, OP13_SQL


def tokenizer_path() -> str:
    """Where the byte-level BPE vocabulary is on this machine; pass another path to the operator to use another."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def pii_key(spark: SparkSession) -> bytes:
    """The key of surrogates, from the session's ``spark.siltstone.pii.key``; without one, a fixed text for synthetic tables and a warning:
    whoever reads it here can link those surrogates to entities."""
    key = spark.conf.get("spark.siltstone.pii.key", None)
    if key is None:
        warnings.warn("spark.siltstone.pii.key is not set: surrogates are made under a public key", stacklevel=2)
    return (key or "synthetic tables only").encode()


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{said}' AS text")
    rows = table(spark, sf_dir, "conversations").selectExpr("CAST(conv_id AS BIGINT) AS conv_id", "CAST(turn AS BIGINT) AS turn", "role", "text")
    return chat.digests(chat.format_trees(chat.from_turns(rows.unionByName(extra))))


#: Of op3: turns and loss text straight from the rows; the template's length follows from its marks and escapes.
OP3_SQL = r"""
WITH rows_ AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text)
), said AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         sum(17 + length(role) + length(text)
             + length(regexp_replace(role, '[^<\[\\\n]', '', 'g')) + length(regexp_replace(text, '[^<\[\\]', '', 'g'))) AS formatted_chars
  FROM rows_ GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM said
"""


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.result(html_density.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: Of op5: all pairs, and reachability by recursion.
OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95
), reach AS (
  SELECT x, x AS y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), low AS (SELECT x, min(y) AS m FROM reach GROUP BY x), degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN low ON low.x = vec_id LEFT JOIN degree ON degree.x = vec_id
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)


#: Of op7: every query against every row.
OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, pii_key(spark)).select("doc_id", F.size("pii").cast("long").alias("n_entities"), "text", "pii")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, tokenizer_path(), decoded="decoded"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weights for all sources, in blocks of 64 documents."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def piece_path() -> str:
    """Where the sentencepiece model is on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), piece_path())


def op12_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_kmers.digests(super_kmers.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is moved on first, so that some neighbours of one place carry another label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return norm_buckets.hard_negatives(moved, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_minhash": op2_minhash,
        "op3_chat": op3_chat,
        "op4_html": op4_html,
        "op5_cross_polytope": op5_cross_polytope,
        "op6_toxicity": op6_toxicity,
        "op7_vafile": op7_vafile,
        "op8_pii": op8_pii,
        "op9_bpe": op9_bpe,
        "op10_mixing": op10_mixing,
        "op11_alignment": op11_alignment,
        "op12_super_kmers": op12_super_kmers,
        "op13_norm_buckets": op13_norm_buckets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1_SQL, "op2_minhash": OP2_SQL, "op3_chat": OP3_SQL, "op5_cross_polytope": OP5_SQL, "op7_vafile": OP7_SQL, "op10_mixing": OP10_SQL, "op12_super_kmers": OP12_SQL, "op13_norm_buckets": OP13_SQL}
