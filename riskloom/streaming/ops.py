"""Structured Streaming twins of the batch operators (SM-1 .. SM-6).

Sources are file streams (replayed fixture tables); state lives in the
streaming state store, checkpoints in the shared ``spark.checkpoint.dir``.
Every stateful step is bounded per micro-batch by the trigger limits
(``maxFilesPerTrigger``), and keyed state by watermarks or a fixed-size
ring buffer.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.operators.ordering import materialize, top_k_per_group
from riskloom.operators.quality import rolling_drift
from riskloom.operators.scoring import feed_summary, score_claims
from riskloom.session import ensure_checkpoint_dir, ship_package
from riskloom.sources.sinks import alert_rows


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskloom-streams/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """Replay a Parquet folder as a stream (bounded micro-batches)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_to_table(sdf: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a streaming query to completion (``availableNow``) into a Parquet
    table and return that table.  Non-append modes rewrite the table each batch."""
    spark = sdf.sparkSession
    out, ckpt = _scratch(spark, name), _scratch(spark, name + "-ckpt")
    w = sdf.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").outputMode("append").start(out)
    else:
        q = w.outputMode(mode).foreachBatch(
            lambda b, _id: b.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def _replace_batch(df: DataFrame, path: str, batch_id: int, fmt: str = "parquet") -> None:
    """Write one micro-batch into its own partition folder: a batch that is retried
    replaces what it wrote before, so the sink holds every row once."""
    df.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")


def stream_score(claims: DataFrame, profile: DataFrame, log_path: str, alert_path: str, ckpt: str, as_of: dt.datetime | None = None):
    """SM-1 + SO-4 + SO-10: score arriving claims against a static (broadcast)
    profile; every micro-batch goes to the prediction log, and its HIGH and
    MEDIUM alerts (alert tiers, with the action) to JSON lines.  The batch is scored once."""
    scored = score_claims(claims, profile)

    def sink(batch: DataFrame, batch_id: int) -> None:
        own = batch.persist()
        _replace_batch(own, log_path, batch_id)
        _replace_batch(alert_rows(own, as_of), alert_path, batch_id, "json")
        own.unpersist()

    return scored.writeStream.option("checkpointLocation", ckpt).foreachBatch(sink) \
                 .trigger(availableNow=True).start()


def stream_feed(scored: DataFrame, tiles_path: str, ckpt: str):
    """SM-6 + AG-22: per micro-batch tiles (count, flagged, max score)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        _replace_batch(feed_summary(batch), tiles_path, batch_id)
    return scored.writeStream.option("checkpointLocation", ckpt).foreachBatch(sink) \
                 .trigger(availableNow=True).start()


def stream_windows(events: DataFrame, size: str, slide: str | None, delay: str = "10 minutes") -> DataFrame:
    """SM-2 / SM-4: event-time windows with a watermark; counts per window and
    type, mean value.  Append mode emits a window once the watermark passes it."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type") \
                 .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value")) \
                 .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                         "event_type", "n", "avg_value")


DEDUP_STATE = "scored_at long"


def _keep_scored(ttl: int):
    """Arriving requests of a key in event-time order; the state is the time at
    which the key was last scored.  A request is scored if that was more than ``ttl`` seconds before."""
    limit = ttl * 1_000_000

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["t", "row_id"], kind="mergesort")
        last = state.get[0] if state.exists else None
        t = rows["t"].to_numpy()
        keep, at = [], 0
        while at < len(t):                  # jump from one scored request to the next
            if last is not None:
                at = int(np.searchsorted(t, last + limit, side="right"))
            if at < len(t):
                keep.append(at)
                last = int(t[at])
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + ttl * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if keep:
            yield pd.DataFrame({"row_id": rows["row_id"].to_numpy()[keep], "ts": rows["ts"].to_numpy()[keep], "request_key": key[0]})
    return run


def stream_dedup(requests: DataFrame, row_id: str, key_col: str = "request_key", ttl: int = 600) -> DataFrame:
    """SM-5: of the requests of a key, those that the result cache cannot answer
    (the streaming twin of ``ttl.mark_scored``).  State per key: the time of the
    last scored request, dropped when the watermark has passed its expiry."""
    own = requests.select(F.col(row_id).cast("long").alias("row_id"), "ts", F.unix_micros("ts").alias("t"), F.col(key_col).alias("request_key")) \
        .withWatermark("ts", f"{ttl} seconds")
    ship_package(requests.sparkSession)
    return own.groupBy("request_key").applyInPandasWithState(
        _keep_scored(ttl), "row_id long, ts timestamp, request_key string", DEDUP_STATE, "append", GroupStateTimeout.EventTimeTimeout) \
        .withColumnRenamed("row_id", row_id)


def stream_rolling_drift(events: DataFrame, profile: DataFrame, folder: str, ckpt: str, key: str = "event_type", order: tuple = ("ts", "event_id"),
                         value: str = "value", frame: int = 20, expire: str = "30 days"):
    """SM-3 in two phases, for streams of which one may hold most rows: a micro-batch goes through the batch operator, whose
    buckets spread a hot stream over all cores, together with each stream's last ``frame - 1`` rows, which are all the state
    there is.  Results go to ``folder/rolled``, the tails to ``folder/tail``, a folder per micro-batch that a retry replaces.

    Equals the batch operator if files arrive in event-time order; a late row rolls with the rows it finds.  A stream without
    rows for ``expire`` before the newest row of a batch is forgotten."""
    spark, columns = events.sparkSession, [key, *order, value]

    def sink(batch: DataFrame, batch_id: int) -> None:
        own = batch.select(*columns).withColumn("is_new", F.lit(True))
        if batch_id:
            own = own.unionByName(spark.read.schema(own.schema).parquet(f"{folder}/tail/batch_id={batch_id - 1}").withColumn("is_new", F.lit(False)))
        rows = materialize(own)
        _replace_batch(rolling_drift(rows, profile, key, list(order), value).where("is_new").drop("is_new"), f"{folder}/rolled", batch_id)
        tail = top_k_per_group(rows.drop("is_new"), [key], [F.desc(c) for c in order], frame - 1)
        alive = rows.groupBy(key).agg(F.max(order[0]).alias("_last")).crossJoin(F.broadcast(rows.agg(F.max(order[0]).alias("_now")))).where(F.expr(f"_last >= _now - interval {expire}"))
        _replace_batch(tail.join(alive.select(key), key, "left_semi").select(*columns), f"{folder}/tail", batch_id)

    return events.writeStream.option("checkpointLocation", ckpt).foreachBatch(sink).trigger(availableNow=True).start()


RING = 20
ROLL_OUT = "event_id long, event_type string, roll_n long, roll_mean double, roll_std double"
ROLL_STATE = "vals array<double>"


def _ring_roll(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """SM-3 state function: keep the last 19 values of the stream, emit the
    trailing-20 count / mean / sample stdev for every arriving row."""
    parts = [p for p in pdfs if len(p)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True).sort_values(["ts", "event_id"], kind="mergesort")
    before = np.array(state.get[0] if state.exists else [], dtype=float)
    vals = pd.Series(np.concatenate([before, rows["value"].to_numpy(dtype=float)]))
    roll = vals.rolling(RING, min_periods=1)
    own = slice(len(before), None)
    state.update((vals.to_numpy()[-(RING - 1):].tolist(),))
    yield pd.DataFrame({"event_id": rows["event_id"].astype("int64").to_numpy(), "event_type": key[0],
                        "roll_n": np.minimum(np.arange(1, len(vals) + 1), RING)[own],
                        "roll_mean": roll.mean().to_numpy()[own], "roll_std": roll.std(ddof=1).to_numpy()[own]})


def stream_rolling(events: DataFrame) -> DataFrame:
    """SM-3: per event stream, a ring buffer of the last 20 values in keyed state."""
    ship_package(events.sparkSession)
    return events.groupBy("event_type").applyInPandasWithState(
        _ring_roll, ROLL_OUT, ROLL_STATE, "append", GroupStateTimeout.NoTimeout)
