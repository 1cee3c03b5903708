import json

import pytest

from quarry.streaming.mailbox import current_log, mailbox_stream


def test_killed_between_the_sinks_nothing_is_lost_or_doubled(spark, tmp_path):
    box, archive, target, checkpoint = (str(tmp_path / x) for x in ("box", "archive", "target", "cp"))
    (tmp_path / "box").mkdir()

    def put(name, *rows):
        (tmp_path / "box" / name).write_text("\n".join(json.dumps({"text": t, "action": a}) for t, a in rows))

    def run(hook=None):
        query = mailbox_stream(spark, box, archive, target, checkpoint, capacity=3, after_memories=hook)
        query.awaitTermination(120)
        return query

    put("1.json", ("remember the garden", "saveAsMemory"), ("hello there", "startConversation"), ("  ", "saveAsMemory"), ("remember the garden", "saveAsMemory"))

    def killed(number):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(killed)
    assert spark.read.parquet(f"{target}/memories").count() == 2  # the first sink was reached, the second wasn't
    run()
    put("2.json", ("second", "saveAsMemory"), ("a question of more than thirty characters", "startConversation"))
    run()
    put("3.json", ("third", "saveAsMemory"), ("hello there", "startConversation"))
    run()
    run()
    memories = spark.read.parquet(f"{target}/memories").collect()
    assert sorted(r.content for r in memories) == ["remember the garden", "remember the garden", "second", "third"]
    assert {tuple(r.keywords) for r in memories if r.content == "second"} == {("second",)} and {r.source_title for r in memories} == {"Shared Content"}
    assert sorted(r.content for r in current_log(spark, target).collect()) == ["remember the garden", "second", "third"]
    heads = {r.id: r.title for r in spark.read.parquet(f"{target}/heads").collect()}
    messages = spark.read.parquet(f"{target}/messages").collect()
    assert sorted(heads.values()) == ["a question of more than thirty...", "hello there", "hello there"] and len(heads) == 3
    assert {(r.conv_id, r.turn, r.role) for r in messages} == {(i, 0, "user") for i in heads}
    put("4.json", ("fourth", "saveAsMemory"))
    run()
    assert sorted(r.content for r in current_log(spark, target).collect()) == ["fourth", "second", "third"]  # the oldest fell out
    assert list((tmp_path / "archive").rglob("1.json")) and not (tmp_path / "box" / "1.json").exists()
