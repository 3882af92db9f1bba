"""Queries of the subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import capfilter, htmltext, jaccard, lattice, media, packing, pii, sentencepieces, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules that judge urls and label the others.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def byte_bpe() -> str:
    """The public byte-level BPE file of the ids contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), byte_bpe())


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.columns(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_table(spark, sf_dir, "documents"))


def op10_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.near_duplicates(_table(spark, sf_dir, "embeddings"))


def piece_bpe() -> str:
    """The public SentencePiece model file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(_table(spark, sf_dir, "documents"), piece_bpe(), group_col="lang")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(_table(spark, sf_dir, "documents"), piece_bpe())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are of the fixed patterns, like the hash; those of all spans are in spans."""
    found = pii.detect(_table(spark, sf_dir, "documents"))
    return found.withColumns({f"n_{k}": F.regexp_count("base_spans", F.lit(f"{k}:")).cast("long") for k in pii.KINDS})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_JACCARD_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(l, i, i + 4), ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i FROM w WHERE len(l) > 0)
), n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.k + y.k - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id WHERE r.root < u.b)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(root) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""

_CAP_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.z > 0 AND b.z > 0 WHERE list_inner_product(a.e, b.e) / (a.z * b.z) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id WHERE r.root < u.b),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS k FROM u GROUP BY 1)
SELECT vec_id, coalesce(k, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the two joins; the other operators learn, tokenize, compress or parse, and are tested against brute force."""
    return {"op6_ngram_jaccard": _JACCARD_SQL, "op10_cap_filters": _CAP_SQL}
