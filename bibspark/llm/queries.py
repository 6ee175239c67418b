"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_bpe_round_trip
from .chat import OP4_SQL, op4_chat_format
from .divergence import OP13_SQL, op13_source_divergence
from .exactdedup import OP6_SQL, op6_exact_dedup
from .fuzzyhash import op3_fuzzy_fingerprints
from .langid import op1_language_id
from .neardup import op5_jaccard_join
from .packing import op9_pack_sequences
from .pieces import op12_piece_round_trip
from .privacy import op7_personal_data
from .resample import OP11_SQL, op11_importance_resampling
from .secrets import op8_secret_scan
from .warc import OP10_SQL, op10_warc_round_trip


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_bpe_round_trip, op3_fuzzy_fingerprints, op4_chat_format, op5_jaccard_join, op6_exact_dedup, op7_personal_data, op8_secret_scan, op9_pack_sequences, op10_warc_round_trip, op11_importance_resampling, op12_piece_round_trip, op13_source_divergence, pipeline)
}
SQL = {"op4_chat_format": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op10_warc_round_trip": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op13_source_divergence": OP13_SQL}
