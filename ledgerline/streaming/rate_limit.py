"""Request-rate limit per client (ST1), batch and streaming.

Rule: a request is rejected when at least ``limit`` *accepted* requests of
the same client lie in the preceding ``window_s`` seconds; rejected requests
do not count.

* ``offered_load`` — the simpler screen that counts every request in the
  window: a range-frame window count, fully JVM-side, partitioned by
  (client, time bucket) so a busy client is not one task.
* ``decide`` (exact, batch) — decisions depend on earlier decisions, so they
  are made sequentially per client. Gaps of at least ``window_s`` reset the
  state, so each client's timeline is cut at such gaps (found per time
  bucket, not with one window per client) and every piece is decided
  independently; a task holds whole pieces, one after another. A client that never
  pauses for a whole window remains one sequential piece: the rule itself
  is sequential.
* ``decide_stream`` (streaming) — the same rule as a stateful operator with
  ``applyInPandasWithState``. A client's state is the accepted timestamps
  that a request above the watermark can still see; an event-time timer
  drops it once the client has been idle for a window past the watermark.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_MICROS = 1_000_000


def offered_load(df: DataFrame, key: str, ts: str, window_s: int = 60, limit: int = 100,
                 span_windows: int = 16) -> DataFrame:
    """Requests in the preceding window (this one excluded) and a breach flag.

    The count only looks back one window, so rows are partitioned by
    (client, time bucket of ``span_windows`` windows) instead of by client:
    a very busy client spreads over many tasks. A row in the last window of
    its bucket is also sent to the next bucket as context (about
    1/``span_windows`` of the rows), so every window frame sees all the rows
    it needs.
    """
    window_us = window_s * _MICROS
    span_us = window_us * span_windows
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    own_bucket = F.floor(t / F.lit(span_us))
    tagged = df.withColumn("_t", t).withColumn("_b", own_bucket)
    spill = F.when(F.col("_t") >= (F.col("_b") + 1) * F.lit(span_us) - F.lit(window_us),
                   F.array(F.struct(F.col("_b").alias("b"), F.lit(True).alias("own")),
                           F.struct((F.col("_b") + 1).alias("b"), F.lit(False).alias("own")))) \
        .otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(True).alias("own"))))
    rows = tagged.withColumn("_x", F.explode(spill))
    w = (Window.partitionBy(key, F.col("_x.b")).orderBy("_t")
         .rangeBetween(-(window_us - 1), 0))
    counted = rows.withColumn("prior_requests", F.count(F.lit(1)).over(w) - 1)
    return (counted.where(F.col("_x.own")).drop("_t", "_b", "_x")
            .withColumn("breach", F.col("prior_requests") >= limit))


def _admit(t: int, accepted: deque, limit: int, window_us: int) -> bool:
    """Decide the next request of a piece against the accepted ones still in its window."""
    while accepted and t - accepted[0] >= window_us:
        accepted.popleft()
    if len(accepted) >= limit:
        return False
    accepted.append(t)
    return True


def decide(df: DataFrame, key: str, ts: str, id_col: str, window_s: int = 60, limit: int = 100,
           span_windows: int = 64) -> DataFrame:
    """Exact accept/reject per request: ``id_col``, ``key``, ``ts``, ``accepted``.

    A gap of at least one window resets the rule, so each client's timeline
    is cut into pieces at such gaps and every piece is decided on its own.
    The cut is found without a window over a client's whole history: rows
    are grouped in (client, time bucket of ``span_windows`` windows); inside
    a bucket the previous row and the latest piece start come from windows,
    and what a bucket needs from earlier buckets (last timestamp, last piece
    start) comes from a per-client table with one row per bucket.
    """
    window_us = window_s * _MICROS
    span_us = window_us * span_windows
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(id_col, key, ts, t.alias("_t")).withColumn("_b", F.floor(F.col("_t") / F.lit(span_us)))
    inb = Window.partitionBy(key, "_b").orderBy("_t", id_col)
    rows = rows.withColumn("_prev", F.lag("_t").over(inb))
    per_bucket = rows.groupBy(key, "_b").agg(F.max("_t").alias("_last"), F.min("_t").alias("_first"))
    chain = Window.partitionBy(key).orderBy("_b")  # one row per (client, bucket)
    per_bucket = per_bucket.withColumn("_prev_last", F.lag("_last").over(chain))
    rows = rows.join(per_bucket.select(key, "_b", "_prev_last"), [key, "_b"])
    prev = F.coalesce(F.col("_prev"), F.col("_prev_last"))
    rows = rows.withColumn("_new", prev.isNull() | (F.col("_t") - prev >= window_us))
    upto = inb.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_start_in", F.last(F.when(F.col("_new"), F.col("_t")), ignorenulls=True).over(upto))
    starts = rows.groupBy(key, "_b").agg(F.max(F.when(F.col("_new"), F.col("_t"))).alias("_bstart"))
    carried = starts.withColumn("_carry", F.last("_bstart", ignorenulls=True).over(
        chain.rowsBetween(Window.unboundedPreceding, -1)))
    pieces = (rows.join(carried.select(key, "_b", "_carry"), [key, "_b"])
              .withColumn("_piece", F.coalesce("_start_in", "_carry"))
              .select(id_col, key, ts, "_t", "_piece"))

    def run(batches):
        # The pieces of a task follow one another in order; what is kept between rows are the last accepted times.
        accepted, left = deque(), 0
        for batch in batches:
            flags = []
            for t, size in zip(batch.column("_t").to_pylist(), batch.column("_size").to_pylist()):
                if not left:
                    accepted.clear()
                    left = size
                left -= 1
                flags.append(_admit(t, accepted, limit, window_us))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (id_col, key, ts)] + [pa.array(flags, pa.bool_())],
                                             [id_col, key, ts, "accepted"])

    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"{id_col} {fields[id_col]}, {key} {fields[key]}, {ts} {fields[ts]}, accepted boolean"
    # A piece with at most `limit` requests never rejects one: decide those in
    # the JVM and send only the longer pieces through the sequential step.
    sizes = pieces.groupBy(key, "_piece").agg(F.count(F.lit(1)).alias("_size"))
    sized = pieces.join(sizes, [key, "_piece"])
    short = sized.where(F.col("_size") <= limit).select(id_col, key, ts, F.lit(True).alias("accepted"))
    long = (sized.where(F.col("_size") > limit).repartition(key, "_piece")
            .sortWithinPartitions(key, "_piece", "_t", F.asc_nulls_last(id_col)).mapInArrow(run, schema))
    return short.unionByName(long)


def _accept(times_us, accepted: list, limit: int, window_us: int) -> list[bool]:
    """Decide requests in time order against a sorted list of accepted timestamps, which grows by the accepted ones."""
    out = []
    for t in times_us:
        end = bisect_right(accepted, t)
        free = end - bisect_right(accepted, t - window_us, 0, end) < limit
        if free:
            accepted.insert(end, t)
        out.append(free)
    return out


def decide_stream(stream: DataFrame, key: str, ts: str, id_col: str, window_s: int = 60, limit: int = 100,
                  watermark: str = "1 hour", rows_out: int = 50_000) -> DataFrame:
    """Accept/reject per request as it arrives: ``id_col``, ``key``, ``ts``, ``accepted``.

    The requests of a micro-batch are decided in (time, id) order. A request
    older than some already decided is judged by the accepted ones of the
    window before its own time; it does not change what was decided. Requests
    older than the watermark get no row (Spark counts them as dropped), as do
    those without a time. In order of time the result is that of ``decide``.

    State: the accepted timestamps later than the watermark less one window,
    and none from the moment the watermark is a window past the last one. Of
    a client's arriving rows only time and id are held
    for ordering, and decisions leave in frames of ``rows_out`` rows; the trigger's size bounds both.
    """
    window_us = window_s * _MICROS
    src = (stream.where(F.col(ts).isNotNull()).withWatermark(ts, watermark)
           .select(id_col, key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")))
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    out_schema = f"{id_col} {fields[id_col]}, {key} {fields[key]}, {ts} {fields[ts]}, accepted boolean"

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [(b["_t"].to_numpy(), b[id_col].to_numpy(), b[ts].to_numpy()) for b in batches]
        times, ids, stamps = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((ids, times))
        times, ids, stamps = times[order], ids[order], stamps[order]
        watermark_us = state.getCurrentWatermarkMs() * 1000
        accepted = [t for t in (state.get[0] if state.exists else []) if t > watermark_us - window_us]
        for at in range(0, len(times), rows_out):
            some = times[at:at + rows_out]
            flags = _accept(some.tolist(), accepted, limit, window_us)
            yield pd.DataFrame({id_col: ids[at:at + rows_out], key: k[0], ts: stamps[at:at + rows_out],
                                "accepted": flags})
        if accepted:
            state.update((accepted,))
            # Fires when the watermark is past this moment; a request above it no longer sees the last one.
            state.setTimeoutTimestamp(max((accepted[-1] + window_us) // 1000 + 1, watermark_us // 1000 + 1))

    return src.groupBy(key).applyInPandasWithState(step, out_schema, "accepted_us array<bigint>", "append",
                                                   GroupStateTimeout.EventTimeTimeout)
