"""Memories: the stream gives the rows of the batch, with versions, expiry and late turns."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodewell.operators import memory, merge
from lodewell.streaming import memory as stream

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
KIND = "conv_id long, memory_type string, content string, turn long, at timestamp"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(stream._STORE, None)
    spark.conf.set(stream._STORE, stream.ROCKS)
    yield
    spark.conf.unset(stream._STORE) if before is None else spark.conf.set(stream._STORE, before)


def write(folder, batches):
    folder.mkdir()
    for i, events in enumerate(batches):
        lines = [json.dumps({"conv_id": c, "memory_type": m, "content": x, "turn": t, "at": (START + dt.timedelta(minutes=at)).isoformat()}) for c, m, x, t, at in events]
        (folder / f"{i:03}.json").write_text("\n".join(lines))
        os.utime(folder / f"{i:03}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in the order of their times


def run(spark, tmp_path, batches, ttl="1 hour", late="2 hours"):
    """(rows of the stream, rows of the batch), with times in minutes."""
    write(tmp_path / "in", batches)
    events = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    log = stream.memories(events, ttl, late)
    query = log.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    every = spark.read.schema(KIND).json(str(tmp_path / "in"))
    now = F.lit(every.agg(F.max("at")).first()[0]) - F.expr(f"INTERVAL {late}")
    shown = lambda df: sorted((r["conv_id"], r["memory_type"], int((r["first_at"].replace(tzinfo=None) - START.replace(tzinfo=None)).total_seconds() // 60), r["content"], r["version"], r["status"]) for r in df.collect())
    return shown(stream.current(spark.read.parquet(str(tmp_path / "out")))), shown(memory.generations(every, ttl, now))


def test_stream_and_batch_agree_on_versions_expiry_and_late_turns(spark, rocks, tmp_path):
    batches = [
        [(1, "topic", "a", 0, 0), (1, "topic", "b", 1, 10), (2, "topic", "x", 0, 0), (1, "profile", "p", 0, 0)],
        [(1, "topic", "d", 3, 100), (2, "topic", "", 1, 20), (2, "topic", None, 2, 30), (4, "topic", "m", 0, 100)],  # a new generation of conversation 1; nothing new of 2
        [(1, "topic", "c", 2, 50), (4, "topic", "n", 1, 160)],  # late, and joins both generations
        [(3, "topic", "far", 0, 400)],  # everything before expires
        [(1, "topic", "e", 4, 390)],
    ]
    got, expected = run(spark, tmp_path, batches)
    assert got == expected
    assert (1, "topic", 0, "d", 4, "expired") in got and (1, "topic", 390, "e", 1, "live") in got and (2, "topic", 0, "x", 1, "expired") in got and (4, "topic", 100, "n", 2, "expired") in got


def test_turns_behind_the_watermark_change_nothing(spark, rocks, tmp_path):
    got, expected = run(spark, tmp_path, [[(1, "topic", "a", 5, 600)], [(1, "topic", "b", 6, 610)], [(1, "topic", "old", 0, 10), (1, "topic", "c", 7, 620)]])
    assert got == [(1, "topic", 600, "c", 3, "live")] and len(expected) == 2


def test_random_streams_equal_their_batches(spark, rocks, tmp_path):
    rng = random.Random(3)
    for n in range(2):
        events = [(rng.randrange(3), rng.choice("ab"), f"t{i}", i, 6 * i + rng.randrange(-50, 50)) for i in range(60)]
        (tmp_path / str(n)).mkdir()
        got, expected = run(spark, tmp_path / str(n), [events[i : i + 12] for i in range(0, 60, 12)], ttl="40 minutes", late="3 hours")
        assert got == expected and len(got) > 6


def test_a_stream_needs_a_store_for_its_state(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        stream.memories(spark.createDataFrame([], KIND), "1 hour", "1 hour")


def test_memories_by_rule(spark):
    said = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(["GPT and more", "cloud", "an API in the Cloud", "x", "vector"])]
    rows = spark.createDataFrame([*said, (2, 0, "assistant", "cloud")], "conv_id long, turn long, role string, text string")
    known = spark.createDataFrame([(1, ["chess", "gpt"])], "conv_id long, interests array<string>")
    found = spark.createDataFrame([(1, [("web", "y" * 300)] * 7)], "conv_id long, collected array<struct<tool:string,output:string>>")
    got = {(r["conv_id"], r["memory_type"]): json.loads(r["content"]) for r in memory.by_rule(rows, known=known, found=found).collect()}
    assert got[1, "user_profile"] == {"interests": ["chess", "gpt", "cloud", "api", "vector"]}
    assert got[1, "conversation_state"] == {"current_topic": "vector", "information_gathered": ["[web] " + "y" * 100] * 5, "open_questions": []}
    assert got[2, "user_profile"] == {"interests": []} and got[2, "conversation_state"]["current_topic"] is None
    assert memory.by_rule(rows.limit(0)).count() == 0


def test_a_memory_is_set_with_its_time(spark):
    kind = "conv_id long, memory_type string, content string, version int, updated_at string"
    stored = spark.createDataFrame([(1, "topic", "a", 3, "mon"), (2, "topic", "b", 1, "mon")], kind)
    batch = spark.createDataFrame([(1, "topic", "c", "tue"), (2, "topic", "", "tue"), (3, "topic", "d", "tue")], "conv_id long, memory_type string, content string, updated_at string")
    got = sorted((r["conv_id"], r["content"], r["version"], r["updated_at"]) for r in merge.merge_memories(stored, batch).collect())
    assert got == [(1, "c", 4, "tue"), (2, "b", 1, "mon"), (3, "d", 1, "tue")]
