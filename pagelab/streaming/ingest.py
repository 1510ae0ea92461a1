"""L: Structured Streaming forms of page ingestion and scoring.

Both run with the ``availableNow`` trigger (process what has arrived, then
stop), keep their progress in a checkpoint under the shared checkpoint
folder, and write through ``foreachBatch`` so a replayed micro-batch
overwrites its own output (idempotent per batch id) after a failure.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelab.functions.html import CONTROL_CHARS_RE, strip_ws


def page_stream(spark: SparkSession, folder: str, schema, name_glob: str = "*.parquet",
                max_files: int | None = 1) -> DataFrame:
    """Files arriving in ``folder`` (matching ``name_glob``) as a stream, at most
    ``max_files`` a micro-batch; None takes all that have arrived."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(folder)


def ingest_dedup(stream: DataFrame, known: DataFrame, url: str = "url", html: str = "html",
                 event_time: str = "ts", min_len: int = 100, watermark: str = "1 hour") -> DataFrame:
    """L1: arriving pages validated (A12), already-known URLs dropped with a
    stream-static anti join (A7; ``known`` holds what the sink has already),
    duplicates dropped (A13, bounded state): the row that arrives first stays.
    The watermark follows the pages' own ``event_time``, so a replay is judged as
    the first run was, and a row later than the watermark is not let in again."""
    s = stream.where(F.length(strip_ws(F.col(html))) > min_len) \
        .withColumn(html, F.regexp_replace(F.col(html), CONTROL_CHARS_RE, ""))
    s = s.join(known.select(url), url, "left_anti")
    return s.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([url])


def first_arrivals(stream: DataFrame, key: str = "url", event_time: str = "ts", order: tuple = (),
                   ttl: str = "2 hours", watermark: str = "1 hour") -> DataFrame:
    """L1 with keyed state: a key's first arrival is let through and its event time is
    kept in the state store until the watermark has passed that time plus ``ttl``; until
    then all further arrivals of the key are dropped, across micro-batches and restarts.
    Afterwards the key is new again (a page is crawled anew). Rows later than the
    watermark are dropped, so a replay does not come back when its state has gone.

    Defined results: of one micro-batch's rows of a key the smallest (event time,
    ``order`` columns) wins, nulls of ``order`` last; a null key is a key like any other; rows
    without an event time are dropped; the state is one time a key. A key that holds much
    of a micro-batch is reduced to one row an Arrow batch before the shuffle."""
    ranks, width = [event_time, *order], pd.Timedelta(ttl).value // 1_000_000
    if width <= 0:
        raise ValueError("ttl must be positive")

    def firsts(batches):
        for pdf in batches:
            yield pdf.sort_values(ranks, kind="stable").drop_duplicates(key)

    def judge(_, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:  # known: its rows need no look; a timer does not outlive a call
            state.setTimeoutTimestamp(max(state.get[0], state.getCurrentWatermarkMs() + 1))
            return
        best = None
        for pdf in batches:  # a running minimum: the key's rows are never held together
            best = pdf if best is None else pd.concat([best, pdf])
            if len(best) > 1:
                best = best.sort_values(ranks, kind="stable").head(1)
        if best is None:
            return
        until = best[event_time].iloc[0].value // 1_000_000 + width
        state.update((until,))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield best

    s = stream.where(F.col(event_time).isNotNull())
    s = s.mapInPandas(firsts, s.schema).withWatermark(event_time, watermark)
    return s.groupBy(key).applyInPandasWithState(judge, stream.schema, "until long", "append",
                                                 GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Drain the stream (availableNow) into ``out_path``; each micro-batch is
    written under its own batch id, so a retried batch replaces itself."""
    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").format(fmt).save(f"{out_path}/batch_id={batch_id}")
    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def score_stream(stream: DataFrame, featurize, model) -> DataFrame:
    """L2: a fitted featuriser + model applied to arriving pages."""
    return model.transform(featurize(stream))
