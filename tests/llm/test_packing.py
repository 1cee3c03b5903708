import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from quarry.llm.packing import Encoder, Packer, SumOfSquares, packed, packed_in_order
from tests.llm.test_quality import thue_morse


def encoder():
    return Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_ids_equal_the_tokenizer():
    rng = random.Random(12)
    parts = ["a", " ", "\n", "bc", "'s", "'", "!", "1", " \n", "\t", "é", " ", "ü ", "  ", "'re", "Tx", "<|endoftext|>", "中", "\r\n", " ", "　", "😀", ".", "-", "\x1f", "\x85"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2500))]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = encoder()
    for k in range(0, len(texts), 500):
        some = texts[k : k + 500]
        for t, got in zip(some, e.texts(pa.array(some, pa.string())), strict=True):
            assert got.tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)
    e.most = 50  # forgetting changes nothing
    assert [x.tolist() for x in e.texts(pa.array(texts[:200], pa.string()))] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts[:200]]


def test_level_is_that_of_the_least_sum_of_squares():
    rng = random.Random(13)
    for _ in range(300):
        s = SumOfSquares(32)
        for _ in range(rng.randint(0, 60)):
            s.put(rng.randint(1, 31), None)
        size = rng.randint(1, 31)

        def squares(h, s=s, size=size):
            n = s.counts.copy()
            n[h] -= h > 0
            n[h + size] += h + size < s.window
            return int((n[1:-1] ** 2).sum())

        options = [h for h in range(0, s.window - size + 1) if h == 0 or s.counts[h]]
        assert squares(s.level_for(size)) == min(map(squares, options))


def check_pieces(rows, texts, window):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(texts)
    for i, text in texts.items():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sequences


def test_pieces(spark):
    rng = random.Random(14)
    texts = {i: " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 300))) for i in range(400)} | {1000: None, 1001: "", 1002: "long text " * 30_000}
    df = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, length int").repartition(3)
    rows = packed(df, window=512).collect()
    sequences = check_pieces(rows, texts, 512)
    tokens = sum(r.length for r in rows)
    assert len(sequences) * 512 - tokens <= 3 * 512  # a partition pads one window at most
    assert packed(df.limit(0)).count() == 0


def test_a_packer_holds_only_open_windows():
    p, rng = Packer(64, 0), random.Random(15)
    for i in range(5000):
        p.add(i, np.ones(rng.randint(1, 200), np.uint32))
    assert sum(map(len, p.levels.open)) < 400


def test_texts_with_structure_and_repeated_rows(spark):
    texts = {2 * k + j: x for k, n in enumerate((1024, 4096, 65536)) for j, x in enumerate(thue_morse(n))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    check_pieces(packed(df).collect(), texts, 2048)
    twice = packed(df.where("doc_id = 0").union(df.where("doc_id = 0")).union(spark.createDataFrame([(None, "a")], df.schema)).coalesce(1), window=64).collect()
    rows = [(r.doc_id, r.start, r.length) for r in twice]
    assert sum(n for i, _, n in rows if i == 0) == 2 * twice[0].doc_tokens and (None, 2) == next((i, n) for i, _, n in rows if i is None)


def test_equal_hashes_change_no_ids(monkeypatch):
    from quarry.llm import packing

    real = packing.span_hashes
    monkeypatch.setattr(packing, "span_hashes", lambda d, a, b, seed=0: real(d, a, b, seed) if seed else real(d, a, b) % np.uint64(50))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = [" ".join(f"word{k * j}" for j in range(40)) for k in range(30)]
    assert [x.tolist() for x in encoder().texts(pa.array(some))] == [plain.encode(t, add_special_tokens=False).ids for t in some]


def test_sequences_are_numbered_in_order(spark, tmp_path):
    rng = random.Random(16)
    texts = {i: " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 200))) for i in range(300)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    docs = docs.select("*", F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).cast("long").alias("part"), F.col("_metadata.row_index").alias("row"))
    rows = packed_in_order(docs, "part", "row", window=128).collect()
    sequences = check_pieces(rows, texts, 128)
    assert sorted(sequences) == list(range(len(sequences)))
    parts = {r.doc_id: r.part for r in docs.collect()}
    by_number = [parts[r.doc_id] for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert by_number == sorted(by_number)
    assert packed_in_order(docs.limit(0), "part", "row").count() == 0
