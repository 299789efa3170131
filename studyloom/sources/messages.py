"""Message streams. The broker's connector has to be on the class path; files stand for it in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def read_topic(spark: SparkSession, servers: str, topic: str, most: int = 8, start: str = "latest") -> DataFrame:
    """A topic as a stream of ``key, value, timestamp``; at most ``most`` messages a batch."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).option("maxOffsetsPerTrigger", most).load()
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "timestamp")


def read_folder(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Text files of JSON lines as a stream of ``value``; ``files`` new ones a batch."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(folder)


def write_topic(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """A stream of ``key, value`` to a topic."""
    return messages.select("key", "value").writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)
