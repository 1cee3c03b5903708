import datetime
import io
import json
import random
import zipfile
import zlib

from pyspark.sql import functions as F

from quarry import schemas
from quarry.operators import catalog, chunking, conversations, memory, retrieval, stats, workers
from quarry.plans import queries
from quarry.sources import documents as S
from quarry.streaming import ingest
from tests.conftest import SF
from tests.test_sources import CONTAINER, OPF, archive


def test_truncated_archives_give_what_stands_before_the_cut():
    data = archive({"a.html": "A" * 500, "b.html": "B" * 500, "c.html": "C" * 500})
    at = data.index(b"c.html")
    assert sorted(S.archive_files(data[: at + 10])) == ["a.html", "b.html"]
    assert S.archive_files(b"no archive") == {} == S.archive_files(b"")
    broken = bytearray(data)
    broken[data.index(b"b.html") + 8] ^= 0xFF
    assert "c.html" in S.archive_files(bytes(broken))


def test_of_a_large_file_the_first_part_counts():
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr(zipfile.ZipInfo("stored.txt"), "s" * 5000)
        z.writestr("deflated.txt", "d" * 5000, zipfile.ZIP_DEFLATED)
    found = S.archive_files(packed.getvalue(), most=2000)
    assert len(found["stored.txt"]) == 5000 and found["deflated.txt"] == b"d" * 2000
    assert zlib.MAX_WBITS == 15


def test_ids_follow_the_content(spark, tmp_path):
    ids = []
    for text in ("one", "two", "one"):
        (tmp_path / "x.txt").write_text(text)
        ids.append(S.read_documents(spark, str(tmp_path)).first().kb_id)
    assert ids[0] == ids[2] != ids[1]


def test_pages_keep_their_numbers(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"first|  |third")
    rows = S.read_documents(spark, str(tmp_path), lambda data: data.decode().split("|")).orderBy("pos").collect()
    assert [(r.label, r.text) for r in rows] == [("Page 1", "first"), ("Page 3", "third")]


def test_conversations_from_files(spark, tmp_path):
    chat = {"id": "c", "title": "T", "messages": [{"id": "m", "role": "user", "content": "hi"}, {"id": "n", "role": "assistant", "content": "ho"}]}
    (tmp_path / "good.json").write_text(json.dumps([chat, {"id": "d", "title": "U"}], indent=1))
    (tmp_path / "bad.json").write_text("[{nonsense")
    rows = {r.id: r for r in conversations.read_conversations(spark, str(tmp_path)).collect()}
    assert set(rows) == {"c", "d"} and [m.content for m in rows["c"].messages] == ["hi", "ho"] and rows["d"].messages is None and rows["c"].domain_id is None
    flat = conversations.messages_of(conversations.read_conversations(spark, str(tmp_path))).collect()
    assert [(r.conversation_id, r.pos, r.role) for r in flat] == [("c", 0, "user"), ("c", 1, "assistant")]
    heads = spark.createDataFrame([("c", "T")], "id string, title string")
    messages = spark.createDataFrame([("c", 1, "b"), ("c", 0, "a")], "id string, pos int, content string")
    assert [m.content for m in conversations.snapshots(heads, messages, "id", "pos").first().messages] == ["a", "b"]


def test_memories_from_an_older_place(spark, tmp_path):
    row = ("1", "c", ["k"], "t", datetime.datetime(2024, 1, 1), None, None)
    S.write_memories(spark.createDataFrame([row], schemas.MEMORY), str(tmp_path / "old"))
    new = str(tmp_path / "new")
    assert S.read_memories(spark, new).count() == 0
    assert S.read_memories(spark, new, str(tmp_path / "old")).first().content == "c"
    assert S.read_memories(spark, new).first().keywords == ["k"]


def test_saving_a_memory(spark):
    held = spark.createDataFrame([("1", "held", ["a"], "t", datetime.datetime(2024, 1, 1), None, None)], schemas.MEMORY)
    typed = lambda i, text, words: (i, text, [], "Manual Entry", datetime.datetime(2024, 2, int(i)), None, None, words)
    entry = spark.createDataFrame([typed("2", " held ", ""), typed("3", "garden garden spade", ""), typed("4", "fresh", " One, two ,,"), typed("5", "  ", "x"), typed("6", "fresh", "")], schemas.MEMORY + ", typed string")
    got = {r.id: (r.content, r.keywords) for r in memory.saved(held, entry).collect()}
    assert got == {"1": ("held", ["a"]), "3": ("garden garden spade", ["garden", "spade"]), "4": ("fresh", ["one", "two"])}
    assert [r.id for r in memory.saved(held, entry, 2).collect()] == ["4", "3"]
    filled = memory.filled(held, lambda c: F.array(F.length(c).cast("double"))).first()
    assert filled.embedding == [4.0] and memory.deleted(held).count() == 0 == memory.deleted(held, "1").count()
    assert memory.moved(held, "1", "d").first().domain_id == "d" and memory.moved(held, "9", "d").first().domain_id is None


def test_stored_bytes_are_those_of_json(spark):
    c = spark.createDataFrame([(1, "a"), (2, "é")], "id long, text string")
    chunks = spark.createDataFrame([("xyz", [1.0]), ("é", None)], "content string, embedding array<double>")
    row = stats.stored_bytes(c, c.limit(0), chunks).first()
    size = sum(len(json.dumps({"id": i, "text": t}, separators=(",", ":"), ensure_ascii=False).encode()) for i, t in ((1, "a"), (2, "é")))
    assert (row.conversation_bytes, row.memory_bytes, row.chunk_bytes, row.bytes) == (size, 0, 5 + 4096, size + 5 + 4096)


def test_old_knowledge_bases_come_once(spark):
    old = spark.createDataFrame([("a", "A", "pdf", 0.0, None, 1, 10, None, None), ("b", "B", "odd", 5.0, 6.0, 0, 10, "m", "d")], schemas.KNOWLEDGE_BASE_JSON)
    rows = catalog.bases_from_json(old)
    by = {r.id: r for r in rows.collect()}
    assert by["a"].created_at == by["a"].updated_at == datetime.datetime(2001, 1, 1) and by["b"].updated_at == datetime.datetime(2001, 1, 1, 0, 0, 6)
    chunks = spark.createDataFrame([("c", "a")], "id string, knowledge_base_id string")
    none = rows.limit(0)
    bases, held = catalog.migrated(none, rows, chunks.limit(0), chunks)
    again, more = catalog.migrated(bases, rows, held, chunks)
    assert bases.count() == again.count() == 2 and held.count() == more.count() == 1


def test_domains_and_flags(spark):
    domains = spark.createDataFrame([("g", "General", None, True)], schemas.DOMAIN)
    now = F.lit("2024-01-01").cast("timestamp")
    made = catalog.domain_created(catalog.domain_created(domains, "n", " New ", now), "x", "  ", now)
    assert sorted(r.name for r in made.collect()) == ["General", "New"] and catalog.listed(made).first().id == "g"
    row = spark.range(1).select(schemas.type_icon(F.lit("epub")).alias("i"), schemas.state_label(F.lit("failed"), F.lit("why")).alias("l"), schemas.state_icon(F.lit("queued")).alias("q"), schemas.keywords_json(F.array(F.lit("a"))).alias("j"), schemas.keywords_json(F.lit(None).cast("array<string>")).alias("n")).first()
    assert tuple(row) == ("book", "why", "clock", '["a"]', "[]")
    assert schemas.Embedder("m", 64).available is False and schemas.Embedder("m", 64, lambda c: c).available


def test_presets_come_only_where_none_is_built_in(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    presets = workers.presets(spark, now)
    none = presets.limit(0)
    assert workers.seeded_once(none, presets).count() == 6 and workers.seeded_once(presets.limit(1), presets).count() == 1
    assert workers.seeded(presets.limit(2), presets).count() == 6
    own = workers.created(none, "1", "Proofread", "when", "do", now)
    assert workers.seeded(own, presets).count() == 7  # one's own of that name doesn't count
    assert [r.name for r in workers.library(workers.seeded(own, presets), True).limit(2).collect()] == ["Code Reviewer", "Explain Simply"]
    done, rest = workers.drained(spark.createDataFrame([("c", 2, "w"), ("c", 1, "v")], "conversation string, seq int, worker string"), F.lit(1))
    assert [r.worker for r in done.collect()] == ["v"] and rest.count() == 1 and workers.removed(own).count() == 0


def test_texts_and_addresses_come_in_together(spark):
    rows = [(1, 0, "text", "words"), (1, 1, "url", "http://a"), (1, 2, "text", "both"), (1, 2, "url", "http://b"), (2, 0, "text", ""), (3, 0, "url", "http://c"), (4, 0, "image", "x")]
    got = workers.intake(spark.createDataFrame(rows, "k int, o int, kind string, value string"), "k", "o").collect()
    assert {(r.k, r.text) for r in got} == {(1, "words\n\nhttp://a\n\nboth"), (3, "http://c")}


def test_rotation(spark):
    messages = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"garden{t} plant") for t in range(10)] + [(2, 0, "user", "hi")], "c int, t int, role string, text string")
    turns = spark.createDataFrame([(1, 5, True, "before"), (2, 5, False, "kept")], "c int, turns int, has_workers boolean, summary string")
    extract = lambda t: F.concat(F.lit("[Plants, Soil] The garden\nNONE\n[] no keywords\n[bare]\nwatering daily "), F.substring(t, 7, 7))
    done, facts, after = conversations.rotated(messages, turns, "c", "t", "text", extract=extract)
    row = done.first()
    assert done.count() == 1 and row.transcript.startswith("User: garden4 plant\nAssistant: garden5") and (row.summary, row.note) == ("before", conversations.REFRESHED)
    assert [(r.content, r.keywords) for r in facts.sort("line").collect()] == [("The garden", ["plants", "soil"]), ("watering daily garden4", ["daily", "garden4", "watering"])]
    assert conversations.rotated(messages, turns, "c", "t", "text")[1].count() == 0  # a transcript's lines are no facts
    assert {(r.c, r.turns, r.summary) for r in after.collect()} == {(1, 0, "before"), (2, 5, "kept")}


def test_jobs(spark):
    jobs = ingest.queued(spark.createDataFrame([("/x/a.txt",), ("/x/b.pdf",), ("/x/c.epub",)], "path string"), "d")
    assert {(r.file_name, r.status, r.domain_id) for r in jobs.collect()} == {(n, "queued", "d") for n in "abc"}
    now = ingest.progressed(jobs, spark.createDataFrame([("/x/a.txt", "failed", "why")], "path string, status string, error string"))
    assert {r.path[3]: (r.status, r.error) for r in now.collect()} == {"a": ("failed", "why"), "b": ("processing", None), "c": ("queued", None)}
    late = ingest.queued(spark.createDataFrame([("/z.txt", 7), ("/a.txt", 9)], "path string, arrived long"))
    next_ = ingest.progressed(late, spark.createDataFrame([], "path string, status string, error string"))
    assert {r.path: r.status for r in next_.collect()} == {"/z.txt": "processing", "/a.txt": "queued"}  # by arrival, not by name
    more = ingest.queued(spark.createDataFrame([("/0.txt",)], "path string"), before=next_)
    assert {r.path: r.status for r in ingest.progressed(more, spark.createDataFrame([("/z.txt", "completed", None)], "path string, status string, error string")).collect()} == {"/z.txt": "completed", "/a.txt": "processing", "/0.txt": "queued"}
    stopped = ingest.progressed(ingest.cancelled(next_), spark.createDataFrame([("/z.txt", "completed", None)], "path string, status string, error string"))
    assert {r.path: (r.status, r.error) for r in stopped.collect()} == {"/z.txt": ("completed", None), "/a.txt": ("failed", "Cancelled")}
    ended = ingest.cancelled(now)
    assert {r.path[3]: r.error for r in ended.collect()} == {"a": "why", "b": None, "c": "Cancelled"}
    assert [r.path for r in ingest.unfinished(ended).collect()] == ["/x/b.pdf"] and ingest.removed(ended, "/x/b.pdf").count() == 2


def test_streams_of_all_kinds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("word " * 60)
    (tmp_path / "in/b.epub").write_bytes(archive({"META-INF/container.xml": CONTAINER, "OEBPS/content.opf": OPF, "OEBPS/one.xhtml": "<p>" + "chapter " * 40 + "</p>"}))
    (tmp_path / "in/c.pdf").write_bytes(b"page " * 50)
    (tmp_path / "in/d.odd").write_text("?")
    ingest.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 2, lambda data: [data.decode()]).awaitTermination(180)
    jobs = {r.path.rsplit("/", 1)[-1]: (r.status, r.error) for r in spark.read.parquet(str(tmp_path / "out/jobs")).collect()}
    assert jobs == {"a.txt": ("completed", None), "b.epub": ("completed", None), "c.pdf": ("completed", None), "d.odd": ("failed", "Unsupported: .odd")}
    chunks = spark.read.parquet(str(tmp_path / "out/chunks")).collect()
    assert {(r.location_label, tuple(r.keywords)) for r in chunks} == {("Full Text", ("word",)), ("Chapter 1", ("chapter",)), ("Page 1", ("page",))}


def test_numbers_of_a_large_group(spark):
    df = spark.range(2500).select(F.col("id"), (F.col("id") % 7 == 0).alias("k"), F.lit(None).cast("string").alias("n"))
    rows = chunking.enumerated(df, ["k", "n"], "id", span=100).collect()
    for k in (True, False):
        assert [r["index"] for r in sorted(rows, key=lambda r: r.id) if r.k == k] == list(range(sum(r.k == k for r in rows)))


def test_words_are_made_few_times(spark):
    """A tokenizer in a plan is a split by the pattern of what parts words."""
    for name, most in (("keyword_retrieve", 1), ("memory_keyword_retrieve", 1), ("two_phase_retrieve", 2), ("keywords_top8", 1), ("chunk_keywords", 1)):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= plan.count("split(lower(") <= most, (name, plan.count("split(lower("))


def test_exports_of_any_size(spark, tmp_path):
    bases = spark.createDataFrame([("k", "name")], "id string, name string")
    chunks = spark.createDataFrame([("k", i, f"c{i}", None) for i in (2, 0, 1)], "knowledge_base_id string, index int, content string, embedding array<double>")
    S.write_exports(bases, chunks, str(tmp_path / "x"))
    lines = [json.loads(x) for f in sorted((tmp_path / "x/chunks/knowledge_base_id=k").glob("*.json")) for x in f.read_text().splitlines()]
    assert [x["content"] for x in lines] == ["c0", "c1", "c2"] and "embedding" not in lines[0]
    assert spark.read.json(str(tmp_path / "x/bases")).first().name == "name"


def test_two_updates_of_a_vector_change_one_chunk(spark):
    chunks = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0])], "id int, embedding array<double>")
    updates = spark.createDataFrame([(1, 1, [5.0]), (1, 2, None), (2, 1, None), (2, 2, [7.0])], "id int, seq int, embedding array<double>")
    assert sorted((r.id, r.embedding) for r in catalog.updated_vectors(chunks, updates).collect()) == [(1, None), (2, [7.0]), (3, [3.0])]
    assert sorted((r.id, r.embedding) for r in catalog.updated_vectors(chunks, updates.drop("seq")).collect()) == [(1, [5.0]), (2, [7.0]), (3, [3.0])]


def test_members_of_an_archive_are_inflated_one_by_one(spark, tmp_path, monkeypatch):
    """A small archive that unpacks to 80 MB: what is in memory at once are its bytes and one member."""
    import tracemalloc

    pages = {f"p{i:02d}.html": "<p>" + "word " * 800_000 + f"{i}</p>" for i in range(20)}
    data = archive(pages)
    assert len(data) < 1_000_000
    tracemalloc.start()
    n = sum(len(html) for _, _, html in S.archive_sections(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 79_000_000 and peak < 60_000_000
    monkeypatch.setattr(S, "FEW_CHARACTERS", 100)
    (tmp_path / "a.epub").write_bytes(archive({f"p{i}.html": "<p>" + "chapter " * 40 + "</p>" for i in range(5)}))
    (tmp_path / "b.epub").write_bytes(archive({"x.html": " "}))
    rows = S.read_documents(spark, str(tmp_path)).collect()
    assert sorted((r.label, r.error) for r in rows if r.path.endswith("a.epub")) == [(f"Section {i}", None) for i in range(1, 6)]
    assert [r.error for r in rows if r.path.endswith("b.epub")] == ["No text content found"]
