"""Running streams: the state store that keyed processors need, counts of late rows, and runs to the end of what has landed."""

from __future__ import annotations

import logging
from collections import Counter
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

log = logging.getLogger(__name__)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which map state and timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


@contextmanager
def state_partitions(spark: SparkSession):
    """Streams started inside deal their state to twice as many partitions as the cluster has cores, or as many as the session says if
    that is less: every micro-batch opens each partition's store, and the small ones of a stream aren't put together."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), max(8, 2 * spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dropped(progress) -> int:
    """Rows that the stateful operators of one micro-batch dropped as later than the watermark. Windows count rows after
    their partial aggregation."""
    return sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)


class LateRows(StreamingQueryListener):
    """Counts the late rows of every stream of a session by its name (else its id) and logs them as they occur.
    ``spark.streams.addListener(LateRows())``."""

    def __init__(self) -> None:
        self.late: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        n = dropped(event.progress)
        if n:
            name = event.progress.name or str(event.progress.id)
            self.late[name] += n
            log.warning("%s: %d rows later than the watermark", name, n)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def late_rows(query: StreamingQuery) -> int:
    """The late rows in the progress that a stream still holds (the last spark.sql.streaming.numRecentProgressUpdates
    micro-batches); a stream that runs on is counted by ``LateRows``."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def run_to_end(stream: DataFrame, folder: str, keyed: bool = True) -> tuple[DataFrame, int]:
    """What a stream has written to ``folder``/out once all that has landed is read, and how many rows it dropped as late. The
    same folder again goes on where the last run stopped. Without ``keyed`` the session's own state store is used."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    with state_partitions(spark), keyed_state(spark) if keyed else nullcontext():
        query = writer.trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    late = late_rows(query)
    if late:
        log.warning("%s: %d rows later than the watermark", folder, late)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), late
