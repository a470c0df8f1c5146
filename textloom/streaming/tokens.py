"""Streams of documents: tokenization holds no state, so a stream is annotated as a table is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators import tokenizer


def token_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 16) -> DataFrame:
    """Tokens of the Parquet files that arrive in a folder (schema with doc_id and text)."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return tokenizer.with_lexemes(tokenizer.tokenize(docs))


def write_tokens(tokens: DataFrame, path: str, checkpoint: str):
    """Appends a token stream to a Parquet folder, each batch once."""
    return tokens.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
