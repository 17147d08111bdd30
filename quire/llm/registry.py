"""The subpackage's queries and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import annulus, lexical, mixing, neardup, neighbours, packing, quality, secrets, sharding, tokens, toxicity, urls, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus_pipeline.run; imported when it is called, as the operators don't need that file."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_neighbours": neighbours.op1_neighbours,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_mixing": mixing.op3_mixing,
        "op4_secrets": secrets.op4_secrets,
        "op5_urls": urls.op5_urls,
        "op6_tokens": tokens.op6_tokens,
        "op7_sharding": sharding.op7_sharding,
        "op8_quality": quality.op8_quality,
        "op9_neardup": neardup.op9_neardup,
        "op10_packing": packing.op10_packing,
        "op11_lexical": lexical.op11_lexical,
        "op12_warc": warc.op12_warc,
        "op13_annulus": annulus.op13_annulus,
        "pipeline": pipeline,
    }


def oracles() -> dict[str, str]:
    return {"op3_mixing": mixing.SQL, "op4_secrets": secrets.SQL, "op8_quality": quality.SQL, "op11_lexical": lexical.SQL, "op12_warc": warc.SQL, "op13_annulus": annulus.SQL}
