"""Debounced saves: the batch form, the stream in random order, and a restart, against a plain simulation."""

import json
import random
from datetime import UTC, datetime

import pytest

from factweave.streaming import debounce

SCHEMA = "scene_id long, ts timestamp, text string, pov string"
START = 1_700_000_000_000
at = lambda ms: datetime.fromtimestamp((START + ms) / 1000, UTC)


def simulated(rows, gap, chars):
    """A clock for each scene: an edit resets its timer; when it rings, what is new is saved."""
    out = []
    for scene in {r[0] for r in rows}:
        content = lambda r: json.dumps([(r[2] or "").strip(" "), (r[3] or "").strip(" ")], separators=(",", ":"), ensure_ascii=False)
        edits = sorted((r[1], content(r), len((r[2] or "").strip(" "))) for r in rows if r[0] == scene)
        saved = timer = None
        for ts, text, n in [*edits, (10**12, None, 0)]:
            if timer and timer[0] <= ts:
                if timer[1] != saved:
                    saved = timer[1]
                    out.append((scene, timer[0], saved))
            timer = (ts + gap, text) if n >= chars else None
    return sorted(out)


def made(seed):
    rng, rows = random.Random(seed), []
    for scene in range(1, 6):
        ts = 0
        for _ in range(rng.randrange(5, 40)):
            ts += rng.choice([0, 100, 700, 1999, 2000, 2001, 3499, 3500, 9000])
            rows.append((scene, ts, rng.choice(["a", "b", " b ", "", "  ", None, "longer text", "x\"y"]), rng.choice([None, "", "Mara"])))
    return rows


def told(df):
    return sorted((r.scene_id, round(r.saved_at.replace(tzinfo=UTC).timestamp() * 1000) - START, r.content) for r in df.collect())


@pytest.mark.parametrize(("gap", "chars"), [(debounce.SAVE_GAP, debounce.SAVE_CHARS), (debounce.CHECK_GAP, debounce.CHECK_CHARS)])
def test_saves(spark, gap, chars):
    for seed in range(4):
        rows = made(seed)
        edits = spark.createDataFrame([(s, at(ts), t, p) for s, ts, t, p in rows] + [(None, at(0), "a", None), (1, None, "a", None)], SCHEMA)
        assert told(debounce.saves(edits, more=("pov",), gap=gap, chars=chars)) == simulated(rows, gap, chars)
    assert debounce.saves(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_restarts(spark, tmp_path):
    """Edits in random order, in three runs that each start from the checkpoint: what is saved is what the simulation saves, once."""
    before = spark.conf.get(debounce.STATE_STORE[0])
    spark.conf.set(*debounce.STATE_STORE)
    try:
        rows = [r for seed in (7, 8) for r in made(seed)]
        rows = sorted(set(rows), key=str)
        end = max(r[1] for r in rows)
        third = [sorted((r for r in rows if i * end // 3 < r[1] + (i == 0) <= (i + 1) * end // 3), key=lambda r: random.Random(str(r)).random()) for i in range(3)]
        assert sum(map(len, third)) == len(rows)
        (tmp_path / "in").mkdir()
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        for i, part in enumerate([*third, [(99, end + 3_600_000, "end", None)], [(99, end + 7_200_000, "end", None)]]):
            # A part is in random order over several files, as far as the lateness allows.
            for j in range(2 if len(part) > 1 else 1):
                spark.createDataFrame([(s, at(ts), t, p) for s, ts, t, p in part[j::2]], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            if i in (0, 2, 4):  # each run is a new one, from the checkpoint
                query = debounce.stream_saves(source, more=("pov",), late="10 minutes").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
                query.awaitTermination()
        got = [r for r in told(spark.read.schema("scene_id long, saved_at timestamp, content string").parquet(f"{tmp_path}/out")) if r[0] != 99]
        assert got == simulated(rows, debounce.SAVE_GAP, debounce.SAVE_CHARS)
    finally:
        spark.conf.set(debounce.STATE_STORE[0], before)
