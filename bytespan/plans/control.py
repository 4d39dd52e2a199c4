"""Control of a running job: cancel it, see how many bytes it has read, hold its next steps back.

A batch that runs on executors can be cancelled, not paused; work that is done in steps (archives, segments of a
driver's list) asks proceed() between them, which waits while paused and is false once cancelled.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from bytespan.functions.workers import ship


class Control:
    """One job's state; used by the thread that runs it and by others that watch it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.group = spark, f"bytespan-{uuid.uuid4().hex}"
        self.running, self.cancelled = threading.Event(), threading.Event()
        self.running.set()
        self.done = spark.sparkContext.accumulator(0)

    def begin(self, description: str = "") -> None:
        """The calling thread's jobs from now on belong to this control."""
        self.spark.sparkContext.setJobGroup(self.group, description, interruptOnCancel=True)

    def pause(self) -> None:
        if not self.cancelled.is_set():
            self.running.clear()

    def resume(self) -> None:
        self.running.set()

    def cancel(self) -> None:
        """Running jobs end with an error; steps that wait go on, to be told so."""
        self.cancelled.set()
        self.running.set()
        self.spark.sparkContext.cancelJobGroup(self.group)

    def is_paused(self) -> bool:
        return not self.running.is_set()

    def is_cancelled(self) -> bool:
        return self.cancelled.is_set()

    def proceed(self) -> bool:
        """Wait while paused; whether the next step is to be done."""
        self.running.wait()
        return not self.cancelled.is_set()

    def bytes_done(self) -> int:
        """Bytes that finished tasks have passed through counted(). A task that is tried again counts once."""
        return self.done.value

    def counted(self, blobs: DataFrame, column: str = "data") -> DataFrame:
        """The same rows; the bytes of a binary column are counted as they pass."""
        ship(self.spark)
        done = self.done

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done.add(pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index(column)))).as_py() or 0)
                yield batch

        return blobs.mapInArrow(run, blobs.schema)
