from quarry.llm.mixing import mixed, schedule


def plain_schedule(weights):
    total, done, out = sum(weights), [0] * len(weights), []
    for t in range(total):
        ready = [(-(-(done[i] + 1) * total // w), done[i] * total // w, i) for i, w in enumerate(weights) if done[i] < w and done[i] * total // w <= t]
        due, release, i = min(ready)
        out.append((i, done[i], release, due, t))
        done[i] += 1
    return out


def test_schedule_meets_deadlines_and_shares(spark):
    for weights in ([1], [1, 1], [5, 3, 2], [20, 9, 8, 7, 6, 5, 5, 5, 3, 3, 3, 2], [97, 1, 1, 1]):
        rows = sorted(tuple(r) for r in schedule(spark, weights).collect())
        assert rows == sorted(plain_schedule(weights))
        total = sum(weights)
        assert all(release <= turn < due for _, _, release, due, turn in rows)
        order = [lane for lane, *_ in sorted(rows, key=lambda r: r[4])]
        for t in range(total + 1):
            assert all(abs(order[:t].count(i) - t * w / total) < 1 for i, w in enumerate(weights))


def test_whole_and_edge_cases(spark):
    rows = [(i, "x" * (i % 300), ["a", "b", None, "odd"][i % 4], 9) for i in range(1500)] + [(2000, None, "a", 9), (2001, "y" * 500_000, "b", 9), (2001, "y" * 500_000, "b", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    got = mixed(df, {"a": 2, "b": 1}, other=1, block_bytes=1000).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert len({(r.slot, r.place) for r in got if r.doc_id == 2001}) == 1 and all(r.release <= r.slot < r.due for r in got)
    by = {}
    for r in got:
        by.setdefault(r.slot, set()).add(r.source if r.source in ("a", "b") else "other")
    assert all(len(x) == 1 for x in by.values())
    assert mixed(df.limit(0), {"a": 2}).count() == 0


def test_a_small_weight_and_no_names(spark):
    df = spark.createDataFrame([(i, "t", "s") for i in range(10)], "doc_id long, text string, source string")
    assert mixed(df, {}, other=3, block_bytes=4).count() == 10


def test_rows_without_an_id_are_spread_by_their_text(spark):
    df = spark.createDataFrame([(None, f"text {i}", "a") for i in range(400)], "doc_id long, text string, source string")
    for with_text in (True, False):
        got = mixed(df, {"a": 1}, other=1, block_bytes=50, with_text=with_text).collect()
        assert len(got) == 400 and len({r.place for r in got}) == 400 and len({r.slot for r in got}) > 50


def test_columns_of_any_name_come_back(spark):
    docs = spark.createDataFrame([(1, "x", "a", 7, 8, "o", 9)], "doc_id long, text string, source string, __size int, __lane int, __order string, __slice int")
    row = mixed(docs, {"a": 1}, 1, 100, 17, with_text=True).first()
    assert (row["__size"], row["__lane"], row["__order"], row["__slice"], row["text"], row["place"]) == (7, 8, "o", 9, "x", 0)
