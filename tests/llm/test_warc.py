import gzip
import hashlib
import random
from pathlib import Path

from quarry.llm import warc
from quarry.llm.warc import Record, archived_pages, pages_of, quarantine, read_warc, salvage, write_warc


def record(n, body, kind="response", good=True):
    digest = hashlib.sha256(body if good else body + b"x").hexdigest()
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Block-Digest: sha256:{digest}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def ids(found):
    return [x.headers["warc-record-id"][10:-1] for x in found if isinstance(x, Record)]


def gaps(found):
    return [x for x in found if isinstance(x, tuple)]


def test_whole_archives():
    plain = [record(i, bytes([65 + i]) * i * 10) for i in range(5)]
    for data in (b"".join(plain), b"".join(map(gzip.compress, plain)), gzip.compress(b"".join(plain)), plain[0] + gzip.compress(plain[1]) + plain[2] + gzip.compress(plain[3] + plain[4])):
        found = list(salvage(data))
        assert ids(found) == list("01234") and not gaps(found)
    assert list(salvage(b"")) == []


def test_damage_is_skipped_and_logged():
    plain = [record(i, b"payload %d " % i * 20) for i in range(6)]
    for make in (lambda x: x, gzip.compress):
        parts = [make(x) for x in plain]
        at = len(parts[0]) + len(parts[1])
        bad = bytearray(b"".join(parts))
        bad[at + len(parts[2]) // 2] ^= 0xFF
        found = list(salvage(bytes(bad)))
        assert ids(found) == list("01345") and [g[:2] for g in gaps(found)] == [(at, at + len(parts[2]))]
        found = list(salvage(b"junk" + b"".join(parts[:3]) + parts[3][: len(parts[3]) // 2] + parts[4] + parts[5][:-9]))
        assert ids(found) == list("0124") and len(gaps(found)) == 3 and gaps(found)[0][:2] == (0, 4)


def test_failed_checks():
    data = record(0, b"a") + record(1, b"b", good=False) + record(2, b"WARC/1.1\r\nnot a record") + record(3, b"c").replace(b"Content-Length: 1", b"Content-Length: x") + record(4, b"d")
    found = list(salvage(data))
    assert ids(found) == ["0", "2", "4"] and len(gaps(found)) == 2
    inside = record(0, gzip.compress(record(9, b"inner"))) + record(1, b"x")
    assert ids(salvage(inside)) == ["0", "1"]


def test_every_byte_is_accounted_for():
    rng = random.Random(6)
    for _ in range(60):
        data = bytearray(b"".join(rng.choice([gzip.compress, bytes])(record(i, bytes(rng.randrange(256) for _ in range(rng.randint(0, 80))))) for i in range(5)))
        for _ in range(rng.randint(0, 3)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        covered = 0
        spans = sorted({(x.offset, x.offset + x.length) if isinstance(x, Record) else x[:2] for x in salvage(bytes(data))})
        for a, b in spans:
            assert a == covered
            covered = b
        assert covered == len(data)


def test_round_trip(spark, tmp_path):
    html = ["x" * 100, "x" * 100, "short", "short", None, "", "é\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, "x" * 100, "y" * 5000]
    rows = [(i, f"http://a/{i}\r\nx" if i else None, h, "c") for i, h in enumerate(html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in archived_pages(df).collect()}
    assert len(got) == len(html)
    for i, h in enumerate(html):
        body = (h or "").encode()
        first = html.index(h)
        again = len(body) >= 100 and first != i
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None)
    for members in (True, False):
        write_warc(df, str(tmp_path / f"w{members}"), records_per_file=2, members=members)
        back = read_warc(spark, str(tmp_path / f"w{members}")).where("warc_type = 'response'").collect()
        assert {bytes(r.payload).decode() for r in back} == {h or "" for h in html}
        for file in (tmp_path / f"w{members}").glob("part-*"):  # others can read the files too
            raw = gzip.decompress(file.read_bytes()) if members else file.read_bytes()
            assert raw[:10] == b"WARC/1.1\r\n" and raw.endswith(b"\r\n\r\n")
    assert archived_pages(df.limit(0)).count() == 0


def test_repeated_and_missing_page_ids(spark):
    a, b, c = ("a" * 200, "b" * 200, "c" * 200)
    rows = [(1, a), (2, c), (5, a), (5, b), (5, c), (5, b), (None, a), (None, b), (7, b)]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted(((r.page_id, r.payload_digest, r.refers_to) for r in archived_pages(df).collect()), key=repr)
    again = {(5, a): 1, (5, c): 2, (7, b): 5}
    assert got == sorted(((i, sha(h), again.get((i, h))) for i, h in rows), key=repr)


def test_a_member_in_a_later_block_is_no_record():
    data = record(0, b"plain") + record(1, b"x" + gzip.compress(record(9, b"inner")) + b"y") + record(2, b"z")
    found = list(salvage(data))
    assert ids(found) == list("012") and not gaps(found)


def test_members_that_inflate_too_far():
    big = gzip.compress(record(1, b"\0" * 3_000_000))
    data = gzip.compress(record(0, b"a")) + big + gzip.compress(record(2, b"b"))
    found = list(salvage(data, 1_000_000))
    at = len(gzip.compress(record(0, b"a")))
    assert ids(found) == ["0", "2"] and gaps(found) == [(at, at + len(big), "a member of more than 1000000 bytes")]
    assert ids(salvage(data)) == list("012")


def test_large_members_end_with_an_empty_one(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "big " * 5_000_000), (2, "u", "small")], "page_id long, url string, html string").coalesce(1)
    write_warc(df, str(tmp_path / "w"))
    assert {(r.page_id, r.payload_bytes) for r in pages_of(read_warc(spark, str(tmp_path / "w"), payloads=False)).collect()} == {(1, 20_000_000), (2, 5)}


def test_a_damaged_archive_in_the_querys_path(spark, monkeypatch):
    """The archives are damaged between writing and reading: what is whole comes back, and the gap is logged."""
    real = warc.write_warc

    def damaged(pages, path):
        real(pages, path)
        [file] = Path(path).glob("part-*")
        data = bytearray(file.read_bytes())
        at = data.index(warc.MEMBER, 40)  # the second member
        data[at + 30] ^= 0xFF
        file.write_bytes(bytes(data))
        for crc in Path(path).glob(".*.crc"):
            crc.unlink()

    monkeypatch.setattr(warc, "write_warc", damaged)
    read = []
    cut = warc.cut
    monkeypatch.setattr(warc, "cut", lambda df, name: read.append(cut(df, name)) or read[-1])
    df = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 40) for i in range(5)], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.gap_before for r in archived_pages(df).collect()}
    [gap] = quarantine(read[-1]).collect()
    assert set(got) == {0, 2, 3, 4} and got[2] == gap.length > 0 and got[3] == 0 and gap.gap == "a member is damaged"
