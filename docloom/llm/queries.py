"""Queries of this subpackage, for the driver: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.perplexity import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.lineage import staged
    from docloom.llm.rff_quality import fit, score, statistics

    stats = staged(statistics(_table(spark, sf_dir, "documents")), "statistics")
    model = fit(stats, _table(spark, sf_dir, "labels").where(_remainder(3) != 1))
    return score(stats, model).select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.toxicity import fit, predict

    docs = _table(spark, sf_dir, "documents")
    chain = fit(docs, _table(spark, sf_dir, "labels").where(_remainder(3) != 1))
    # learned from the rows whose remainder is not 1; toxic documents are those not kept
    return predict(docs, chain).withColumn("kept", F.col("predicted") == 0)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.near_dedup import near_groups

    return near_groups(_table(spark, sf_dir, "documents"), threshold=0.85)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docloom.llm.lineage import shared_path
    from docloom.llm.token_files import crc32_of_ids, read_tokens, write_tokens

    path = shared_path(spark, "tokens")
    write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return crc32_of_ids(read_tokens(spark, path))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.language import fit, identify

    docs = _table(spark, sf_dir, "documents")
    held_out = _remainder(4) == 2
    model = fit(docs.where(~held_out))
    return identify(docs, model, keep=["doc_id", held_out.alias("held_out")])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_html_text": op4_html_text,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_minhash": op7_minhash,
    "op8_mixing": op8_mixing,
    "op9_token_files": op9_token_files,
    "op10_language": op10_language,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
        with d as (
            select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents
        )
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, text_sha256
        from d window g as (partition by text_sha256)
    """,
    "op7_minhash": r"""
        with recursive words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
        ), sets as (
            select doc_id, case when len(w) >= 5 then list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])
                when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from words
        ), shingles as (select doc_id, len(s) as n, unnest(s) as g from sets),
        pairs as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by all),
        links as (select a, b from pairs where 100 * c >= 85 * (na + nb - c)),
        ways as (select a, b from links union all select b, a from links),
        reached as (select doc_id, doc_id as other from documents union select r.doc_id, l.b from reached r join ways l on r.other = l.a)
        select doc_id, len(s)::bigint as n_shingles, min(other) as component_id, doc_id = min(other) as kept from sets join reached using (doc_id) group by doc_id, s
    """,
}
