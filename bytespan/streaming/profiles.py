"""Streams (extensions of the library): incremental corpus profiles and a keyed moving average."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bytespan.registry import query
from bytespan.sources.blobs import table


def corpus_profile(documents: DataFrame) -> DataFrame:
    """Documents and bytes by language; works on a stream and on a table alike."""
    n = F.octet_length(F.coalesce("text", F.lit("")))
    return documents.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_bytes"), F.max(n).cast("long").alias("largest"))


def stream_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_events(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events per tumbling window and type, with a watermark; works on a stream and on a table alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def keyed_average(events: DataFrame) -> DataFrame:
    """The moving average 0.6 / 0.4 of each user's values over a stream; the state is one number a user."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, 0.0)
        for frame in frames:
            for x in frame.sort_values(["ts", "event_id"])["value"].dropna():
                n, ema = n + 1, x if ema == 0 else 0.6 * ema + 0.4 * x
        state.update((n, ema))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "ema": [ema]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


@query("SELECT lang, count(*) AS n_docs, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS n_bytes, max(octet_length(encode(coalesce(text, '')))) AS largest FROM documents GROUP BY lang")
def corpus_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile that the stream keeps, over the table at rest."""
    return corpus_profile(table(spark, sf_dir, "documents"))


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-minute windows of events."""
    return windowed_events(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
