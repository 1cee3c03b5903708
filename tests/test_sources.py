import datetime
import io
import json
import zipfile

from pyspark.sql import functions as F

from quarry.sources import documents as S
from quarry.streaming import ingest


def archive(files):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content)
    return data.getvalue()


CONTAINER = '<rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles>'
OPF = '<manifest><item id="a" href="old.xhtml"/><item id="a" href="one.xhtml"/><item id="b" href="two.xhtml"/><item id="c" href="three.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="missing"/><itemref idref="b"/><itemref idref="c"/></spine>'


def test_spine_order_and_gaps():
    book = archive({"META-INF/container.xml": CONTAINER, "OEBPS/content.opf": OPF, "OEBPS/one.xhtml": "<p>First</p>", "OEBPS/two.xhtml": "<p> </p>", "OEBPS/three.xhtml": "<p>Third</p>"})
    assert [(i, label) for i, label, _ in S.archive_sections(book)] == [(0, "Chapter 1"), (2, "Chapter 3")]


def test_fallback_to_all_pages():
    assert [(label, html) for _, label, html in S.archive_sections(archive({"b.html": "B", "a.htm": "A", "c.txt": "C", "bb.html": " "}))] == [("Section 1", "A"), ("Section 2", "B")]


def test_read_documents(spark, tmp_path):
    (tmp_path / "x.txt").write_text("Some text.")
    (tmp_path / "blank.txt").write_text(" \n ")
    (tmp_path / "y.doc").write_text("?")
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    (tmp_path / "book.epub").write_bytes(archive({"META-INF/container.xml": CONTAINER, "OEBPS/content.opf": OPF, "OEBPS/one.xhtml": "<p>First &amp; only</p>"}))
    rows = {r.path.rsplit("/", 1)[-1]: r for r in S.read_documents(spark, str(tmp_path)).collect()}
    assert (rows["x.txt"].label, rows["x.txt"].text) == ("Full Text", "Some text.")
    assert rows["blank.txt"].error == "No text content found" and rows["y.doc"].error == "Unsupported: .doc" and rows["bad.epub"].error
    assert (rows["book.epub"].label, rows["book.epub"].text) == ("Chapter 1", "First & only")


def test_pasted_and_names(spark):
    df = spark.createDataFrame([(1, "n", "  é \n"), (2, "n", " ")], "kb_id int, name string, text string")
    assert [(r.kb_id, r.text, r.file_size) for r in S.pasted(df).collect()] == [(1, "é", 2)]
    row = spark.range(1).select(S.export_name(F.lit("a/b:c" + "x" * 200)).alias("n"), S.file_stem(F.lit("/p/q.r.txt")).alias("s")).first()
    assert row.n == "a-b-c" + "x" * 95 + ".kb.json" and row.s == "q.r"


def test_export_and_memories(spark, tmp_path):
    bases = spark.createDataFrame([("k", "name"), ("e", "empty")], "id string, name string")
    chunks = spark.createDataFrame([("k", 1, "b", [1.0]), ("k", 0, "a", None)], "knowledge_base_id string, index int, content string, embedding array<double>")
    out = {r.id: json.loads(r.json) for r in S.exported_bases(bases, chunks, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert [c["content"] for c in out["k"]["chunks"]] == ["a", "b"] and out["e"]["chunks"] == []
    memories = spark.createDataFrame([("1", "c", ["k"], "t", datetime.datetime(2024, 1, 1), [1.0], None)], "id string, content string, keywords array<string>, source_title string, created_at timestamp, embedding array<double>, domain_id string")
    S.write_memories(memories, str(tmp_path / "m"))
    back = S.read_memories(spark, str(tmp_path / "m")).first()
    assert back.embedding is None and back.keywords == ["k"]


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("word " * 60)
    (tmp_path / "in/b.txt").write_text("short")
    ingest.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    jobs = {r.path.rsplit("/", 1)[-1]: (r.status, r.error) for r in spark.read.parquet(str(tmp_path / "out/jobs")).collect()}
    assert jobs == {"a.txt": ("completed", None), "b.txt": ("failed", "No chunks created")}
    assert spark.read.parquet(str(tmp_path / "out/chunks")).first().keywords == ["word"]


def test_stateful_streams(spark, tmp_path):
    for k, rows in enumerate(([("a", 0, "A"), ("a", 1, "B"), ("a", 2, "A")], [("a", 3, "C"), ("a", 4, "A")])):
        spark.createDataFrame(rows, "log string, seq long, content string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    adds = spark.readStream.schema("log string, seq long, content string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = ingest.memory_stream(adds, 2).writeStream.format("memory").queryName("taken").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.seq, r.content) for r in spark.table("taken").collect()) == [(0, "A"), (1, "B"), (3, "C"), (4, "A")]
    rows = [(1, t, "user" if t % 2 == 0 else "assistant") for t in range(30)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string").coalesce(1).write.parquet(str(tmp_path / "m"))
    msgs = spark.readStream.schema("conv_id long, turn long, role string").parquet(str(tmp_path / "m"))
    q = ingest.rotations(msgs, 6).writeStream.format("memory").queryName("turned").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.turn for r in spark.table("turned").collect()) == [12, 24]
