"""Cleaning as a Structured Streaming query.

Tokenising, case-folding, stop-word and alphanumeric filtering are stateless
per-row expressions, so the same columns run on a streaming DataFrame; new
files dropped into a folder are cleaned incrementally with exactly-once file
output and a checkpoint in the shared folder.  (Lemmatisation and the
vocabulary need the whole corpus and stay batch operators.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.functions import text as T

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def read_documents_stream(spark: SparkSession, folder: str, schema: str = DOC_SCHEMA,
                          max_files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(folder))


def clean_stream(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """``(doc_id, tokens, processed_content)`` for every arriving document; empty
    documents are dropped (P3)."""
    toks = stream.select("doc_id", T.clean_tokens(text_col).alias("tokens"))
    return toks.where(F.size("tokens") > 0).select("doc_id", "tokens",
                                                   T.join_tokens("tokens").alias("processed_content"))


def start_clean_to_parquet(stream: DataFrame, out: str, checkpoint: str, once: bool = True):
    q = (clean_stream(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    q = q.trigger(availableNow=True) if once else q
    return q.start()
