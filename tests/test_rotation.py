import random

import pytest

from quarry.operators.conversations import REFRESHED
from quarry.streaming.rotation import facts, rotated_batch, rotated_stream

SCHEMA = "conv_id long, turn long, role string, text string, has_workers boolean"


def extract(transcript):
    first = transcript.split("\n")[0]
    return None if "silent" in first else f"[seen, words] {first}\nNONE\n"


def summarise(transcript):
    return None if "silent" in transcript else f"{transcript.count(chr(10)) + 1} lines"


def brute(rows, most=6, recent=6):
    out = []
    for conv in {r[0] for r in rows if r[0] is not None}:
        mine, seen, turns, done, summary, lines = sorted((r for r in rows if r[0] == conv and r[1] is not None), key=lambda r: (r[1], r[2], r[3] or "")), set(), 0, 0, None, []
        for _, turn, role, text, workers in mine:
            if turn in seen:
                continue
            seen.add(turn)
            lines.append(("User: " if role == "user" else "Assistant: ") + (text or ""))
            if role == "user" and turns >= (max(most - 1, 3) if workers else most):
                transcript = "\n".join(lines[-recent:])
                new = summarise(transcript)
                summary = new if new is not None else summary or ""
                turns, done = 0, done + 1
                lines.append(f"Assistant: {REFRESHED}")
                out.append((conv, turn, done, transcript, summary, extract(transcript)))
            turns += role == "assistant"
    return sorted(out, key=lambda r: r[:2])


def talks(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(6):
        for turn in range(rng.randrange(5, 60)):
            role = ("user" if turn % 2 == 0 else "assistant") if conv % 2 else rng.choice(["user", "assistant", "assistant", "system"])
            rows.append((conv, turn, role, rng.choice([f"w{turn}", "silent", None]), conv % 3 == 0))
    return rows + [(None, 1, "user", "x", False), (0, None, "user", "x", False), rows[0]]


def test_a_batch_equals_the_plain_way(spark):
    rows = talks(1)
    got = sorted((tuple(r) for r in rotated_batch(spark.createDataFrame(rows, SCHEMA).repartition(3), extract=extract, summarise=summarise).collect()), key=lambda r: r[:2])
    assert got == brute(rows) and len(got) > 5
    assert rotated_batch(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("cuts", [1, 4])
def test_a_stream_cut_anywhere_equals_the_batch(spark, tmp_path, cuts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(cuts)
    rows = [r for r in talks(2) if r[0] is not None and r[1] is not None]
    bounds = {c: sorted(rng.randrange(60) for _ in range(cuts - 1)) for c in range(6)}
    parts = [[r for r in rows if sum(r[1] >= b for b in bounds[r[0]]) == k] for k in range(cuts)]
    parts[-1] += parts[0][:5]  # delivered again
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = rotated_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), extract=extract, summarise=summarise)
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(240) and query.exception() is None
    made = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert sorted((tuple(r) for r in made.collect()), key=lambda r: r[:2]) == brute(rows)
    found = facts(made).collect()
    assert found and all(r.keywords == ["seen", "words"] and r.content.startswith(("User", "Assistant")) for r in found)
