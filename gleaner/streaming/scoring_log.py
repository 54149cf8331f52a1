"""A scoring log that can be replayed, cut and taken up again. The reference keeps its events in one file a run; that a stream follows
them is an extension.

Runs append JSON lines of events (request_id, seq, status, result) to files of a folder. A run that dies leaves a cut line, a run that is
repeated the same events again, and events of a request may come late. Of each request only the event with the highest seq counts;
of equal ones the greatest by status and result, so that the outcome depends on no order of arrival.

A stream carries the latest event of each request in its state and writes what a batch changed into that batch's own folder, which a
repeated batch replaces; reading takes the latest over all folders. So no crash between writing and committing leaves a result twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "request_id string, seq long, status string, result string"
DONE = ("pass", "fail")


def parse(lines: DataFrame) -> DataFrame:
    """Events of text lines (value); what is no event (cut, blank, without request or number) has null columns and its text in ``line``."""
    e = F.from_json("value", EVENT)
    sound = e["request_id"].isNotNull() & e["seq"].isNotNull()
    return lines.select(*[F.when(sound, e[c]).alias(c) for c in ("request_id", "seq", "status", "result")], F.when(~F.coalesce(sound, F.lit(False)), F.col("value")).alias("line"))


def latest(events: DataFrame) -> DataFrame:
    """The event of each request that counts; on a stream the state holds one event a request."""
    best = F.max(F.struct("seq", "status", "result")).alias("b")
    return events.where("request_id IS NOT NULL").groupBy("request_id").agg(best).select("request_id", "b.seq", "b.status", "b.result")


def open_requests(planned: DataFrame, events: DataFrame) -> DataFrame:
    """Planned requests (request_id) whose latest event is no verdict: what a resumed run has still to ask."""
    done = latest(events).where(F.col("status").isin(*DONE)).select("request_id")
    return planned.select("request_id").distinct().join(done, "request_id", "left_anti")


def follow(spark: SparkSession, log: str, out: str, checkpoint: str, files_per_trigger: int = 100) -> StreamingQuery:
    """Takes in what the log holds now and stops; a later call goes on where this one ended, or repeats its last batch."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(log)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = latest(parse(lines)).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def results(spark: SparkSession, out: str) -> DataFrame:
    """The event of each request that counts, of all that was taken in."""
    return latest(spark.read.schema(EVENT).parquet(f"{out}/batch=*"))
