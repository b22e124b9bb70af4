"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cosmolake.llm import op1_odd_sketch, op2_host_paths, op3_skip_chain, op4_line_frequency, op5_kneser_ney, op6_templates, op7_winnowing, op8_warc, op9_byte_bpe, op10_line_crf
from cosmolake.llm._shared import bounded
from cosmolake.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def shipped(f: Query) -> Query:
    """``f`` once the workers have this package and batches are bounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        bounded(spark)
        return f(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    k: shipped(f)
    for k, f in {
        "op1_odd_sketch": op1_odd_sketch.query,
        "op2_host_paths": op2_host_paths.query,
        "op3_skip_chain": op3_skip_chain.query,
        "op4_line_frequency": op4_line_frequency.query,
        "op5_kneser_ney": op5_kneser_ney.query,
        "op6_templates": op6_templates.query,
        "op7_winnowing": op7_winnowing.query,
        "op8_warc": op8_warc.query,
        "op9_byte_bpe": op9_byte_bpe.query,
        "op10_line_crf": op10_line_crf.query,
    }.items()
}

SQL: dict[str, str] = {
    "op1_odd_sketch": op1_odd_sketch.SQL,
    "op4_line_frequency": op4_line_frequency.SQL,
    "op6_templates": op6_templates.SQL,
    "op7_winnowing": op7_winnowing.SQL,
    "op8_warc": op8_warc.SQL,
}
