"""Per-address request limiter: at most ``limit`` admitted requests in any window.

A request is admitted if fewer than ``limit`` requests of its address were
admitted in the ``window`` before it; rejected ones do not count. Whether one is
admitted depends on those before it, so a busy address is a chain. Most traffic
is not busy, and that is settled with counts alone:

* Time is cut into slices one window long. The window before a request reaches
  into its own slice and the one before, no further. If both hold ``limit``
  requests at most, all in the slice are admitted.
* What is left are runs of busy slices. A run, with the quiet slice in front of
  it, stands alone. Its requests are counted per point in time and the points
  gathered in short chunks, all in parallel. What a chunk does to the chain is
  decided by at most ``limit`` admissions, each of which counts until one window
  later: a chunk before the oldest of them ends is skipped as a whole, and inside
  a chunk the walk leaps from one admitting point to the next. So the one ordered
  pass takes as many steps as there are admissions, at most ``limit`` in a window
  however many requests come in it.
* The points that admit go back to the requests. Where a point admits some of
  its requests, those first by ``order`` are admitted.

A request without a time can't be judged: ``admitted`` is NULL and it doesn't count.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden import rules
from logwarden.session import stored

#: Microseconds of a chunk at most, and so points in time that it can hold.
CHUNK = 1 << 17
NOBODY = "unknown"


def _who(ip: str) -> Column:
    return F.coalesce(F.col(ip).cast("string"), F.lit(NOBODY))


def slice_plan(requests: DataFrame, ip: str, ts: str, window: int, limit: int) -> DataFrame:
    """Per address and slice: ``run``, the first slice of the busy run it is in, or NULL if quiet."""
    size = window * 1_000_000
    at = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / size).cast("bigint")
    counts = requests.where(F.col(ts).isNotNull()).groupBy(_who(ip).alias(ip), at.alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(ip).orderBy("slice")
    before = F.when(F.lag("slice").over(order) == F.col("slice") - 1, F.lag("n").over(order))
    busy = counts.withColumn("busy", F.col("n") + F.coalesce(before, F.lit(0)) > limit)
    leads = F.coalesce((F.lead("slice").over(order) == F.col("slice") + 1) & F.lead("busy").over(order), F.lit(False))
    inside = busy.withColumn("inside", F.col("busy") | leads)
    goes_on = F.coalesce((F.lag("slice").over(order) == F.col("slice") - 1) & F.lag("inside").over(order), F.lit(False))
    starts = inside.withColumn("start", F.when(F.col("inside") & ~goes_on, F.col("slice")))
    run = F.when(F.col("inside"), F.last("start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return starts.select(ip, "slice", run.alias("run"))


class Chain:
    """One address's admissions of the last window: ``limit`` of them at most."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.hits: deque[tuple[int, int]] = deque()
        self.active = 0

    def pass_chunk(self, times: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, bool]]:
        """(time, admitted, not all) of the points of a chunk, sorted by time, that admit requests."""
        out, hits, i, end = [], self.hits, 0, len(times)
        while i < end:
            now = int(times[i])
            while hits and hits[0][0] <= now - self.size:
                self.active -= hits.popleft()[1]
            free = self.limit - self.active
            if free <= 0:  # nothing is admitted before the oldest admission ends
                i = int(np.searchsorted(times, hits[0][0] + self.size)) if hits else end
                continue
            n = int(counts[i])
            taken = min(n, free)
            hits.append((now, taken))
            self.active += taken
            out.append((now, taken, taken < n))
            i += 1
        return out


def admitting_points(points: DataFrame, window: int, limit: int) -> DataFrame:
    """who, us, admits, partly: points in time that admit requests, from counted ``points`` (who, run, us, n) of busy runs.

    Points are gathered in chunks of ``CHUNK`` microseconds in parallel; one ordered pass per run reads these.
    """
    size = window * 1_000_000
    step = max(1, min(CHUNK, size // 64))
    sorted_points = F.array_sort(F.collect_list(F.struct("us", "n")))
    chunks = points.groupBy("who", "run", F.floor(F.col("us") / step).alias("chunk")).agg(sorted_points.alias("p"))
    chunks = chunks.select("who", "run", "chunk", F.col("p.us").alias("us"), F.col("p.n").alias("n"))
    chunks = chunks.repartition("who", "run").sortWithinPartitions("who", "run", "chunk")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain = None, Chain(size, limit)
        for batch in batches:
            who, run = batch.column("who").to_pylist(), batch.column("run").to_pylist()
            times, counts = batch.column("us"), batch.column("n")
            us, n = times.flatten().to_numpy(), counts.flatten().to_numpy()
            ends = np.append(0, np.cumsum(times.value_lengths().to_numpy()))
            owners, rows = [], []
            for i, key in enumerate(zip(who, run, strict=True)):
                if key != at:
                    at, chain = key, Chain(size, limit)
                found = chain.pass_chunk(us[ends[i] : ends[i + 1]], n[ends[i] : ends[i + 1]])
                rows += found
                owners += [key[0]] * len(found)
            columns = [pa.array(owners, pa.string()), *[pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.int64(), pa.int64(), pa.bool_()))]]
            yield pa.RecordBatch.from_arrays(columns, ["who", "us", "admits", "partly"])

    return chunks.mapInArrow(walk, "who string, us bigint, admits bigint, partly boolean")


def limit_requests(
    requests: DataFrame, ip: str = "ip", ts: str = "ts", order: str = "event_id",
    window: int = rules.RATE_WINDOW_SECONDS, limit: int = rules.RATE_LIMIT,
) -> DataFrame:
    """Add ``admitted`` to a request log; every request comes back once.

    Whole requests are shuffled by address and time, which spreads a hot address
    over all its points in time. The slice plan and the busy requests are written
    first, so that their real size decides how they are joined. Requests without
    an address share the address "unknown" (a string column says so); those
    without a time get NULL.
    """
    size = window * 1_000_000
    keep = requests.columns
    if dict(requests.dtypes)[ip] == "string":
        requests = requests.withColumn(ip, _who(ip))
    timed = requests.where(F.col(ts).isNotNull()).withColumns({"_who": _who(ip), "_us": F.unix_micros(F.col(ts).cast("timestamp"))})
    timed = timed.withColumn("_slice", F.floor(F.col("_us") / size).cast("bigint"))
    untimed = requests.where(F.col(ts).isNull()).withColumn("admitted", F.lit(None).cast("boolean"))
    plan = stored(slice_plan(requests, ip, ts, window, limit).select(F.col(ip).alias("_who"), F.col("slice").alias("_slice"), "run"), "slices")
    tagged = timed.join(plan, ["_who", "_slice"])
    quiet = tagged.filter(F.col("run").isNull()).select(*keep, F.lit(True).alias("admitted"))

    busy = tagged.filter(F.col("run").isNotNull()).select(*keep, "_who", "_us", "run")
    busy = stored(busy.withColumn("_id", F.monotonically_increasing_id()), "busy").withColumn("_at", F.struct(order, "_id"))
    points = busy.groupBy(F.col("_who").alias("who"), "run", F.col("_us").alias("us")).agg(F.count(F.lit(1)).alias("n"))
    admits = admitting_points(points, window, limit)
    admits = stored(admits.select(F.col("who").alias("_who"), F.col("us").alias("_us"), "admits", "partly"), "admits")
    # The last request that is admitted, where not all of a point are; no more than ``limit`` of a point are ranked.
    ranked = busy.select("_who", "_us", "_at").join(admits.where("partly"), ["_who", "_us"])
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("_who", "_us").orderBy("_at")))
    last = ranked.where(F.col("_rank") <= limit).where(F.col("_rank") == F.col("admits")).select("_who", "_us", F.col("_at").alias("_last"))
    settled = busy.join(admits, ["_who", "_us"], "left").join(last, ["_who", "_us"], "left")
    admitted = F.when(F.col("partly"), F.col("_at") <= F.col("_last")).otherwise(F.col("admits").isNotNull())
    return quiet.unionByName(settled.select(*keep, admitted.alias("admitted"))).unionByName(untimed)


def screen_requests(
    requests: DataFrame, ip: str = "ip", ts: str = "ts", window: int = rules.RATE_WINDOW_SECONDS,
    limit: int = rules.RATE_LIMIT,
) -> DataFrame:
    """Requests in slices where the limit could bind at all (an upper bound, counts only)."""
    plan = slice_plan(requests, ip, ts, window, limit)
    return plan.filter(F.col("run").isNotNull()).select(ip, "slice")


def limit_stream(
    stream: DataFrame, ip: str = "ip", ts: str = "ts", order: str = "event_id", late: str = "10 minutes",
    window: int = rules.RATE_WINDOW_SECONDS, limit: int = rules.RATE_LIMIT,
) -> DataFrame:
    """The limiter on a stream; per address the state is its admitted times in the window.

    State goes once the watermark has passed its last window; requests later
    than the watermark are dropped, as in every stateful stream. Requests without
    an address share one; those without a time pass with ``admitted`` NULL.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    size = window * 1_000_000
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if dict(stream.dtypes)[ip] == "string":
        stream = stream.withColumn(ip, _who(ip))
    untimed = stream.where(F.col(ts).isNull()).withColumn("admitted", F.lit(None).cast("boolean"))
    timed = stream.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    schema = T.StructType([*timed.schema.fields, T.StructField("admitted", T.BooleanType())])
    names = timed.columns

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = deque(state.get[0]) if state.exists else deque()
        pdf = pd.concat(list(frames)).sort_values([ts, order])  # one address in one micro-batch
        flags = []
        for now in pdf[ts].astype("datetime64[us]").astype("int64"):
            while hits and hits[0] <= now - size:
                hits.popleft()
            flags.append(len(hits) < limit)
            if flags[-1]:
                hits.append(int(now))
        state.update((list(hits),))
        expires = (hits[-1] + size) // 1000 if hits else 0
        state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield pdf.assign(admitted=flags)[[*names, "admitted"]]

    done = timed.groupBy(ip).applyInPandasWithState(
        step, schema, "hits array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return done.unionByName(untimed)
