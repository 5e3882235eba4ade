"""View parameters as streams: standing requests answered anew when channel, stokes, cursor or region change.

A request stream has rows (file_id string, seq long, kind string, value string). Of one file and kind the last wins, as a
viewer only wants the newest; PV-preview cuts are answered one by one in order. State is one row per file and kind, kept
by Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REQUEST = "file_id string, seq long, kind string, value string"


def latest(requests: DataFrame) -> DataFrame:
    """The newest value per file and kind, over all that has come in: a stateful aggregate with one row per key."""
    return requests.groupBy("file_id", "kind").agg(F.max(F.struct("seq", "value")).alias("last")).select("file_id", "kind", F.col("last.seq").alias("seq"), F.col("last.value").alias("value"))


def answer(requests: DataFrame, respond: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that, per micro-batch, answers what is new for each file: respond(changed views) -> rows, sink(rows, batch).

    Requests that a later one of the same batch replaces are never computed.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(respond(batch), number)

    return latest(requests).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()


def in_order(requests: DataFrame, respond: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, kind: str = "pv_cut") -> StreamingQuery:
    """Answer every request of a kind, none replaced: rows reach `respond` sorted by file and sequence."""

    def each(batch: DataFrame, number: int) -> None:
        sink(respond(batch.where(F.col("kind") == kind).orderBy("file_id", "seq")), number)

    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()


def frame_of(tick: Column, first: int, last: int, start: int, delta: int = 1, loop: bool = True, reverse: bool = False) -> Column:
    """Channel shown at a tick of an animation.

    Loops start anew at the first frame; reversing ones swing between both ends; others stay at the last frame.
    """
    n = (last - first) // delta + 1
    at = tick + (start - first) // delta
    if reverse and n > 1:
        swing = F.pmod(at, F.lit(2 * (n - 1)))
        index = F.when(swing < n, swing).otherwise(2 * (n - 1) - swing)
    elif loop:
        index = F.pmod(at, F.lit(n))
    else:
        index = F.least(at, F.lit(n - 1))
    return (F.lit(first) + index * delta).cast("int")


def matched_frames(frames: DataFrame, start: float, step: float, depth: int) -> DataFrame:
    """Adds `matched`: the channel of another image nearest to a world coordinate, within its range."""
    at = F.round((F.col("coordinate") - F.lit(start)) / F.lit(step))
    return frames.withColumn("matched", F.least(F.greatest(at, F.lit(0)), F.lit(depth - 1)).cast("int"))


def progressive(cube: DataFrame, depth: int, compute: Callable[[DataFrame], DataFrame], first: int = 10):
    """Partial results over growing channel ranges, as (share done, rows): each job reads only its own channels."""
    at, step = 0, first
    while at < depth:
        end = min(depth, at + step)
        yield end / depth, compute(cube.where((F.col("z") >= at) & (F.col("z") < end)))
        at, step = end, step * 2


def replay(log: DataFrame) -> DataFrame:
    """What a resumed session has to do, in order: of each kind the newest request per file; images first, then channels, cursors and regions, contours, catalogs."""
    order = F.create_map(*[x for i, k in enumerate(("open", "channel", "cursor", "region", "contour", "catalog")) for x in (F.lit(k), F.lit(i))])
    return latest(log).withColumn("step", F.element_at(order, F.col("kind"))).where("step is not null").orderBy(F.col("step") == 5, "file_id", "step", "seq")
