"""Debounced saves and checks: one for each quiet gap in a scene's edits, of the last text, unless it is the one that was saved last.

`saves` is the batch form over all edits; `stream_saves` keeps state for each scene: what was saved last, as a digest, and the
edits that later ones may still follow within the gap. Its event-time timers fire as the watermark passes, so edits
may come in any order up to the allowed lateness, and a restart from the checkpoint goes on where it was.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Milliseconds of quiet before a save, and before a check of the writing; characters that a text needs at least.
SAVE_GAP, SAVE_CHARS = 2000, 1
CHECK_GAP, CHECK_CHARS = 3500, 2
#: A session that streams saves needs this setting, as timers and several states a key need it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _content(*columns: str) -> Column:
    """The trimmed contents, told apart from each other."""
    return F.to_json(F.array(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]))


def _edits(edits: DataFrame, text: str, more: tuple[str, ...], key: str) -> DataFrame:
    return edits.select(F.col(key).cast("long").alias("scene_id"), F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts"), F.length(F.trim(F.coalesce(F.col(text).cast("string"), F.lit("")))).cast("long").alias("n_chars"), _content(text, *more).alias("content")).where("scene_id is not null and ts is not null")


def saves(edits: DataFrame, text: str = "text", more: tuple[str, ...] = (), key: str = "scene_id", gap: int = SAVE_GAP, chars: int = SAVE_CHARS) -> DataFrame:
    """(scene_id, saved_at, content) of a table of edits (key, ts, text and the columns of `more`); content: a JSON list of them, trimmed.

    An edit is saved `gap` milliseconds after it unless another follows before, its text is shorter than `chars`, or the same was saved last.
    Edits of one scene and time go by their content. A null text is empty; edits without a scene or a time are none.
    """
    w = Window.partitionBy("scene_id").orderBy("ts", "content")
    due = F.timestamp_millis(F.unix_millis("ts") + gap)
    last = _edits(edits, text, more, key).withColumns({"saved_at": due, "next": F.lead("ts").over(w)}).where("(next is null or next >= saved_at)").where(F.col("n_chars") >= chars)
    before = F.lag("content").over(Window.partitionBy("scene_id").orderBy("ts"))
    return last.withColumn("before", before).where(~F.col("content").eqNullSafe(F.col("before"))).select("scene_id", "saved_at", "content")


class Debounce(StatefulProcessor):
    """Of each scene the digest that was saved last, and the edits whose gap isn't over."""

    def __init__(self, gap: int, chars: int):
        self.gap, self.chars = gap, chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("saved", StructType([StructField("digest", StringType())]))
        self.open = handle.getValueState("open", StructType([StructField("edits", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        edits = json.loads(self.open.get()[0]) if self.open.exists() else []
        edits += [[int(round(r.ts.timestamp() * 1000)), r.content if r.n_chars >= self.chars else None] for r in rows]
        yield from self._decide(key, edits, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._decide(key, json.loads(self.open.get()[0]) if self.open.exists() else [], timerValues)

    def _decide(self, key, edits: list, timers) -> Iterator[Row]:
        """Saves what is due by the watermark: no earlier edit can come any more."""
        now = timers.getCurrentWatermarkInMs()
        edits.sort(key=lambda e: (e[0], e[1] or ""))
        digest, done = self.saved.get()[0] if self.saved.exists() else None, 0
        for i, (ts, content) in enumerate(edits):
            if ts + self.gap > now:
                break
            done = i + 1
            followed = i + 1 < len(edits) and edits[i + 1][0] < ts + self.gap
            if followed or content is None:
                continue
            new = hashlib.sha256(content.encode()).hexdigest()
            if new != digest:
                digest = new
                self.saved.update((digest,))
                yield Row(scene_id=key[0], due=ts + self.gap, content=content)
        left = edits[done:]
        # The text of an edit that is followed within the gap is never saved; its time still counts.
        left = [[ts, None if i + 1 < len(left) and left[i + 1][0] < ts + self.gap else content] for i, (ts, content) in enumerate(left)]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left:
            self.open.update((json.dumps(left),))
            self.handle.registerTimer(left[0][0] + self.gap)
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def stream_saves(edits: DataFrame, text: str = "text", more: tuple[str, ...] = (), key: str = "scene_id", gap: int = SAVE_GAP, chars: int = SAVE_CHARS, late: str = "10 minutes") -> DataFrame:
    """saves() of a stream of edits, each as soon as the watermark (`late` behind the latest edit) has passed its gap. Edits that come later than that are left out.

    A scene's state is its edits within the gap and the lateness, and one digest.
    """
    out = StructType([StructField("scene_id", LongType()), StructField("due", LongType()), StructField("content", StringType())])
    watched = _edits(edits, text, more, key).withWatermark("ts", late)
    found = watched.groupBy("scene_id").transformWithState(Debounce(gap, chars), out, "Append", "EventTime")
    return found.select("scene_id", F.timestamp_millis("due").alias("saved_at"), "content")

