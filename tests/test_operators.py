import datetime
import random

from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions import vectors as V
from quarry.operators import catalog, chunking, context, conversations, memory, retrieval, stats


def plain_chunks(text, target=600, overlap=100, least=150):
    cur, out = "", []
    for p in (q.strip(" \t") for q in (text or "").split("\n\n")):
        if not p:
            continue
        if len(cur) + len(p) + 2 > target and len(cur) >= least:
            out.append(cur.strip())
            cur = cur[-overlap:] + "\n\n" + p
        else:
            cur = cur + "\n\n" + p if cur else p
    rest = cur.strip()
    if len(rest) >= least:
        out.append(rest)
    elif rest and out:
        out[-1] += "\n\n" + rest
    return out


def test_chunks_equal_a_plain_fold(spark):
    rng = random.Random(3)
    texts = [None, "", "x" * 149, "x" * 150, "y" * 5000, "a\n\n\nb", "p" * 590 + "\n\n" + "q" * 20]
    texts += ["\n\n".join("w" * rng.randint(0, 300) + rng.choice(["", "\nz", " "]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", chunking.chunks_of(F.col("t")).alias("c")).collect()}
    assert got == {i: plain_chunks(t) for i, t in enumerate(texts)}


def test_index_runs_on_over_sections(spark):
    df = spark.createDataFrame([(1, 0, "A", "x" * 200), (1, 1, "B", "short"), (1, 2, "C", "y" * 300)], "kb_id int, pos int, label string, text string")
    rows = chunking.chunk_sections(df).orderBy("index").collect()
    assert [(r["index"], r.location_label) for r in rows] == [(0, "A"), (1, "C")]


def test_vector_math(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), (1, [1.0, 0.0], [0.0, 1.0]), (2, [1.0, 0.0], [-1.0, 0.0]), (3, [], []), (4, [1.0, 2.0], [1.0]), (5, [0.0, 0.0], [1.0, 0.0])], "i int, a array<double>, b array<double>")
    got = {r.i: r.c for r in df.select("i", V.cosine(F.col("a"), F.col("b")).alias("c")).collect()}
    assert [round(got[i], 6) for i in range(6)] == [1, 0, -1, 0, 0, 0]
    row = spark.range(1).select(V.magnitude(V.literal([3, 4])).alias("m"), V.is_normalized(V.literal([1, 0, 0])).alias("u"), V.is_normalized(V.literal([2, 0, 0])).alias("n"), V.normalized(V.literal([0, 0])).alias("z")).first()
    assert (row.m, row.u, row.n, row.z) == (5.0, True, False, [0.0, 0.0])


def test_vector_bytes(spark):
    values = [[1.0, -2.5, 3.14159, 0.0, -0.001], [], [42.0], [0.5] * 512]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v array<double>").coalesce(1)
    rows = V.from_bytes(V.to_bytes(df, "v", "b"), "b", "w").collect()
    assert all(r.v == r.w and (r.v is None) == (r.b is None) and len(r.b or b"") == 8 * len(r.v or []) for r in rows) and len(rows) == 5
    odd = spark.createDataFrame([(b"x" * 17,), (b"",)], "b binary")
    assert sorted(len(r.w) for r in V.from_bytes(odd, "b", "w").collect()) == [0, 2]


def words_df(spark, rows):
    return spark.createDataFrame(rows, "id int, words array<string>, embedding array<double>")


def test_keyword_scores_and_thresholds(spark):
    rows = words_df(spark, [(1, ["swift"], None), (2, ["swiftly"], None), (3, ["other"], None), (4, [], None)])
    got = retrieval.keyword_retrieve(rows, ["swift"], "id", 5).select("id", "score").collect()
    assert [(r.id, r.score) for r in got] == [(1, 1.0), (2, 0.5)]
    assert retrieval.keyword_retrieve(rows, [], "id", 5).count() == 0
    assert [r.id for r in retrieval.keyword_retrieve(rows, ["swift", "aa", "bb", "cc"], "id").collect()] == []


def test_similarity_threshold_is_strict(spark):
    rows = words_df(spark, [(1, [], [0.3, 0.0]), (2, [], [0.31, 0.0]), (3, [], None), (4, [], [1.0])])
    assert [r.id for r in retrieval.vector_topk(rows, [1.0, 0.0], "id").collect()] == [2]


def plain_two_phase(rows, query, words, k, every):
    near = lambda e, w: len(e) >= 5 and len(w) >= 5 and (e.startswith(w) or w.startswith(e))
    hit = lambda ws: any(w in ws or any(near(e, w) for e in ws) for w in words)
    found = {i for i, ws in every if hit(ws)}
    pool = rows if len(rows) < 200 or len(found) < max(3 * k, 20) or not any(i in found for i, _, _ in rows) else [r for r in rows if r[0] in found]
    scored = [(round(sum(x * y for x, y in zip(v, query, strict=True)), 9), i) for i, _, v in pool]
    return [i for s, i in sorted(((s, i) for s, i in scored if s > 0.3), key=lambda x: (-x[0], x[1]))[:k]]


def test_two_phase_branches(spark):
    rng = random.Random(5)
    for n, share in ((199, 0.5), (250, 0.5), (250, 0.02), (250, 0.0)):
        rows = [(i, ["license"] if rng.random() < share else ["nothing"], [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(n)]
        other = [(1000 + i, ["licensed"]) for i in range(30 if share == 0.0 else 0)]
        df = words_df(spark, [*rows, *((i, ws, [0.0, 0.0]) for i, ws in other)])
        got = [r.id for r in retrieval.two_phase(df, [1.0, 0.0], ["license"], "id", 3, own=F.col("id") < 1000).collect()]
        assert got == plain_two_phase(rows, [1.0, 0.0], ["license"], 3, [*((r[0], r[1]) for r in rows), *other])


def test_prefix_matches_equal_the_nested_loop(spark):
    rng = random.Random(7)
    make = lambda n: ["".join(rng.choice("ab") for _ in range(rng.randint(3, 8))) for _ in range(n)]
    entries, queries = sorted(set(make(80))), sorted(set(make(40)))
    got = retrieval.prefix_matches(spark.createDataFrame([(w,) for w in entries], "word string"), spark.createDataFrame([(w,) for w in queries], "word string")).collect()
    expected = {(e, q) for e in entries for q in queries if len(e) >= 5 and len(q) >= 5 and (e.startswith(q) or q.startswith(e))}
    assert {(r.word, r.query_word) for r in got} == expected


def test_packing_stops_at_the_first_that_is_too_long(spark):
    q = spark.createDataFrame([(1, "q"), (2, "alone"), (3, "full")], "query_id int, text string")
    mem = spark.createDataFrame([(1, 0, "m"), (3, 0, "m" * 60)], "query_id int, rank int, content string")
    chunks = spark.createDataFrame([(1, 0, "a", "x" * 10, "A"), (1, 1, "b", "y" * 40, "B"), (1, 2, "c", "z", "C"), (3, 0, "a", "x", "A")], "query_id int, rank int, label string, content string, name string")
    rows = {r.query_id: r for r in context.pack_context(q, mem, chunks, 50).collect()}
    assert rows[2].prompt == "alone" and rows[2].memory_count == 0
    assert (rows[1].memory_count, rows[1].chunk_count, rows[1].document_names) == (1, 1, ["A"]) and rows[1].prompt.endswith("[a] " + "x" * 10)
    assert (rows[3].memory_count, rows[3].chunk_count) == (1, 0)
    line = spark.range(1).select(context.context_summary(F.lit(2), F.lit(1), F.array(F.lit("a"), F.lit("b"))).alias("s")).first().s
    assert line == "2 memories · 1 chunk from a, b"


def plain_log(adds, capacity):
    held = []
    for seq, content in adds:
        if content.strip() and content not in [c for _, c in held]:
            held = [(seq, content), *held][:capacity]
    return set(held)


def test_memory_log_equals_a_plain_fold(spark):
    rng = random.Random(11)
    adds = [(log, seq, rng.choice("ABCDEFG") if log else f"Memory {seq}") for log in (0, 1, 2) for seq in range(105)]
    adds.append((1, 200, "  "))
    df = spark.createDataFrame(adds, "log int, seq int, content string")
    for capacity in (2, 5, 100):
        got = memory.memory_log(df, capacity).collect()
        for log in (0, 1, 2):
            assert {(r.seq, r.content) for r in got if r.log == str(log)} == plain_log([(s, c) for n, s, c in adds if n == log], capacity)


def test_evicted_content_may_come_again():
    assert memory.add_all([], iter([(0, "A"), (1, "B"), (2, "C"), (3, "A")]), 2) == [(2, "C"), (3, "A")]


def test_date_buckets(spark):
    now = datetime.datetime(2024, 3, 31, 12)
    days = {"Today": now, "Yesterday": now - datetime.timedelta(days=1), "This Week": now - datetime.timedelta(days=6), "This Month": now - datetime.timedelta(days=20), "Older": now - datetime.timedelta(days=60)}
    df = spark.createDataFrame([(k, v) for k, v in days.items()], "k string, ts timestamp")
    assert all(r.k == r.b for r in df.select("k", conversations.date_bucket(F.col("ts"), F.lit("2024-03-31 12:00:00").cast("timestamp")).alias("b")).collect())


def test_catalog_changes(spark):
    rows = spark.createDataFrame([("a", None), ("b", "d1"), ("c", "d2")], "id string, domain_id string")
    assert [r.id for r in catalog.of_domain(rows, schemas.GENERAL).collect()] == ["a"]
    assert {r.id for r in catalog.of_domain(rows, "d1", other=True).collect()} == {"a", "c"}
    domains = spark.createDataFrame([("d1", "One", None, False)], schemas.DOMAIN)
    assert catalog.ensure_general(catalog.ensure_general(domains, F.current_timestamp()), F.current_timestamp()).count() == 2
    assert {r.domain_id for r in catalog.domain_deleted(domains, catalog.adopt_orphans(rows), "d1")[1].collect()} == {schemas.GENERAL, "d2"}
    assert catalog.domain_deleted(domains, rows, schemas.GENERAL)[1] is rows
    named = spark.createDataFrame([("a", "old")], "id string, name string")
    assert catalog.renamed(named, "a", "  ").first().name == "old" and catalog.renamed(named, "a", " new ").first().name == "new"
    bases = spark.createDataFrame([("k", 2)], "id string, chunk_count long")
    chunks = spark.createDataFrame([("c1", "k", 0), ("c2", "k", 1)], "id string, knowledge_base_id string, index long")
    after, left = catalog.chunk_deleted(bases, chunks, "c1")
    assert after.first().chunk_count == 1 and [r["index"] for r in left.collect()] == [1]
    assert catalog.chunk_deleted(bases, chunks, "absent")[0].first().chunk_count == 2


def test_memory_update_clears_the_vector_only_for_new_content(spark):
    df = spark.createDataFrame([("1", "c", ["a"], [1.0])], "id string, content string, keywords array<string>, embedding array<double>")
    same, new = memory.updated(df, "1", "c", ["B"]).first(), memory.updated(df, "1", "d", ["B"]).first()
    assert same.embedding == [1.0] and same.keywords == ["b"] and new.embedding is None and new.content == "d"


def test_schema_helpers(spark):
    row = spark.range(1).select(schemas.document_type(F.lit("odd")).alias("t"), schemas.type_label(F.lit("epub")).alias("l"), schemas.json_keywords(F.lit("nonsense")).alias("k"), schemas.reference_date(F.lit(0)).alias("d")).first()
    assert (row.t, row.l, row.k, row.d) == ("text", "ePUB", [], datetime.datetime(2001, 1, 1))


def test_progress_of_no_jobs_is_zero(spark):
    assert spark.createDataFrame([], "s string").agg(stats.queue_progress(F.col("s")).alias("p")).first().p == 0


def test_usage_names_all_workers(spark):
    from quarry.operators import workers

    rows = spark.createDataFrame([(1, f"w{i:03}") for i in range(150)], "k long, worker string")
    assert workers.usage_summaries(rows, "k", "worker").first()["summary"] == "Used " + ", ".join(f"w{i:03}" for i in range(150))
