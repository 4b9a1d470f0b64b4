"""The operators' queries and SQL by name."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from kgloom.llm import ann, bpe, jaccard, langid, media, packing, ppm, quality, secrets, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_ppm": ppm.op2_ppm,
        "op3_jaccard": jaccard.op3_jaccard,
        "op4_packing": packing.op4_packing,
        "op5_secrets": secrets.op5_secrets,
        "op6_ann": ann.op6_ann,
        "op7_warc": warc.op7_warc,
        "op8_media": media.op8_media,
        "op9_langid": langid.op9_langid,
        "op10_bpe": bpe.op10_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard": jaccard.SQL, "op7_warc": warc.SQL}
