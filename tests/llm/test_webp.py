import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

from quarry.llm import webp
from quarry.llm.webp import LENGTH_ORDER, NEARBY, decode, encode, image_of, media_report, payload_of, pixel_arrays, to_media


class Out:
    """Writes streams with all features, for the decoder."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> k) & 1 for k in range(n)]

    def code(self, counts, alphabet):
        """A prefix code of uneven lengths for the symbols used; returns symbol -> bits."""
        used = sorted(counts) or [0]
        if len(used) == 1 and used[0] < 256:
            self.put(0b101, 3)
            self.put(used[0], 8)
            return {used[0]: []}
        if len(used) == 2 and used[1] < 256:
            self.put(0b111, 3)
            self.put(used[0], 8)
            self.put(used[1], 8)
            return {used[0]: [0], used[1]: [1]}
        if len(used) == 1:
            used = sorted({used[0], 0})
        lengths = dict.fromkeys(used, 0)  # lengths 1, 2, 3, ... for the most frequent, one depth for the rest
        by = sorted(used, key=lambda s: -counts.get(s, 0))
        depth = 0
        while len(by) > 2 and depth < 4:
            depth += 1
            lengths[by.pop(0)] = depth
        k = (len(by) - 1).bit_length()
        short = (1 << k) - len(by)
        for i, s in enumerate(by):
            lengths[s] = depth + k - (1 if i < short else 0)
        table = [lengths.get(s, 0) for s in range(alphabet)]
        self.put(0, 1)
        steps = {s: 5 for s in range(19)}
        for s in range(13):
            steps[s] = 4  # 13 codes of 4 bits and 6 of 5 bits are complete
        self.put(15, 4)
        for s in LENGTH_ORDER:
            self.put(steps[s], 3)
        words = canonical(steps)
        self.put(0, 1)
        i = 0
        while i < alphabet:
            run = 1
            while i + run < alphabet and table[i + run] == table[i]:
                run += 1
            if table[i] == 0 and run >= 11:
                run = min(run, 138)
                self.bits += words[18]
                self.put(run - 11, 7)
            elif table[i] == 0 and run >= 3:
                self.bits += words[17]
                self.put(run - 3, 3)
            elif run >= 4:
                run = min(run, 7)
                self.bits += words[table[i]] + words[16]
                self.put(run - 4, 2)
            else:
                self.bits += words[table[i]]
                run = 1
            i += run
        return canonical({s: n for s, n in lengths.items()})

    def number(self, value):
        """(prefix, extra bits, how many)"""
        value -= 1
        if value < 4:
            return value, 0, 0
        extra = value.bit_length() - 2
        return 2 * extra + 2 + ((value >> extra) & 1), value & ((1 << extra) - 1), extra

    def image(self, pixels, width, rng, top=False, cache=0):
        """Entropy-coded ARGB pixels with back-references and, if asked, a colour cache and an entropy image."""
        n = len(pixels)
        self.put(1 if cache else 0, 1)
        if cache:
            self.put(cache, 4)
        groups, block = 1, 2
        if top:
            self.put(int(top == "groups"), 1)
            if top == "groups":
                groups = 3
                self.put(block - 2, 3)
                across, down = -(-width >> block), -(-(n // width) >> block)
                which = [rng.randrange(3) for _ in range(across * down - 1)] + [2]
                self.image([0xFF000000 | g << 8 for g in which], across, rng)
        tokens, held, at = [], [None] * (1 << cache), 0

        def remember(p):
            if cache:
                held[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache)] = p

        while at < n:
            best = (0, 0)
            for back in {b for b in (1, 2, width - 1, width, width + 1, 7 * width + 5, 200) if 0 < b <= at}:
                k = 0
                while at + k < n and pixels[at + k] == pixels[at + k - back] and k < 4096:
                    k += 1
                best = max(best, (k, back))
            p = pixels[at]
            if best[0] >= 3:
                tokens.append((at, "copy", *best))
                for k in range(best[0]):
                    remember(pixels[at + k])
                at += best[0]
                continue
            slot = (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache) if cache else 0
            tokens.append((at, "held", slot) if cache and held[slot] == p else (at, "pixel", p))
            remember(p)
            at += 1
        counts = [[{} for _ in range(5)] for _ in range(groups)]
        coded = []
        for at, kind, *x in tokens:
            g = which[((at // width) >> block) * across + ((at % width) >> block)] if groups > 1 else 0
            if kind == "pixel":
                p = x[0]
                parts = [(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]
            elif kind == "held":
                parts = [(0, 256 + 24 + x[0], 0, 0)]
            else:
                near = [i + 1 for i, (dx, dy) in enumerate(NEARBY) if max(1, dx + dy * width) == x[1]]
                a, b = self.number(x[0]), self.number(near[0] if near else x[1] + 120)
                parts = [(0, 256 + a[0], a[1], a[2]), (4, b[0], b[1], b[2])]
            for k, s, *_ in parts:
                counts[g][k][s] = counts[g][k].get(s, 0) + 1
            coded.append((g, parts))
        sizes = (256 + 24 + ((1 << cache) if cache else 0), 256, 256, 256, 40)
        codes = [[self.code(c, size) for c, size in zip(group, sizes, strict=True)] for group in counts]
        for g, parts in coded:
            for k, s, extra, wide in parts:
                self.bits += codes[g][k][s]
                self.put(extra, wide)

    def file(self):
        body = np.packbits(self.bits, bitorder="little").tobytes()
        body += b"\0" * (len(body) & 1)
        return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def canonical(lengths):
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items() if n):
        code <<= n - last
        last = n
        out[s] = [int(b) for b in format(code, f"0{n}b")]
        code += 1
    return out


def head(width, height, alpha=1):
    o = Out()
    o.put(0x2F, 8)
    o.put(width - 1, 14)
    o.put(height - 1, 14)
    o.put(alpha, 1)
    o.put(0, 3)
    return o


def picture(rng, width, height, colours):
    palette = [rng.randrange(1 << 32) for _ in range(colours)]
    return [palette[(x // 3 + y // 2) % colours] if rng.random() < 0.8 else rng.choice(palette) for y in range(height) for x in range(width)]


def rgba(pixels, width):
    a = np.array(pixels, "<u4").view(np.uint8).reshape(-1, width, 4)
    return a[..., [2, 1, 0, 3]]


@pytest.mark.parametrize("cache", [0, 1, 6, 11])
@pytest.mark.parametrize("top", ["one", "groups"])
def test_codes_references_cache_and_groups(cache, top):
    rng = random.Random(cache)
    for width, height, colours in ((1, 1, 1), (7, 9, 3), (33, 20, 40), (64, 64, 300)):
        pixels = picture(rng, width, height, colours)
        o = head(width, height)
        o.put(0, 1)
        o.image(pixels, width, rng, top, cache)
        assert (decode(o.file()) == rgba(pixels, width)).all()


def add(a, b, sign=1):
    return sum((((a >> s & 255) + sign * (b >> s & 255)) & 255) << s for s in (0, 8, 16, 24))


def predictions(pixels, width, x, y):
    """The fourteen predictions of a pixel, channel by channel."""
    at = lambda i: [pixels[i] >> s & 255 for s in (0, 8, 16, 24)]
    i = y * width + x
    L, T, TL, TR = at(i - 1), at(i - width), at(i - width - 1), at(i - width + 1)  # noqa: N806
    avg = lambda a, b: [(p + q) // 2 for p, q in zip(a, b, strict=True)]
    clamp = lambda v: [min(255, max(0, p)) for p in v]
    whole = [p + q - r for p, q, r in zip(L, T, TL, strict=True)]
    select = L if sum(abs(p - q) for p, q in zip(whole, L, strict=True)) < sum(abs(p - q) for p, q in zip(whole, T, strict=True)) else T
    mean = avg(L, T)
    half = [p + (abs(p - q) // 2) * (1 if p > q else -1) for p, q in zip(mean, TL, strict=True)]
    out = [[0, 0, 0, 255], L, T, TR, TL, avg(avg(L, TR), T), avg(L, TL), mean, avg(TL, T), avg(T, TR), avg(avg(L, TL), avg(T, TR)), select, clamp(whole), clamp(half)]
    return [sum(v << s for v, s in zip(p, (0, 8, 16, 24), strict=True)) for p in out]


def test_predictor():
    rng = random.Random(1)
    width, height, block = 19, 61, 2
    pixels = picture(rng, width, height, 50)
    across = -(-width >> block)
    modes = [i % 14 for i in range(across * -(-height >> block))]
    rest = []
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        q = 0xFF000000 if i == 0 else pixels[i - 1] if y == 0 else pixels[i - width] if x == 0 else predictions(pixels, width, x, y)[modes[(y >> block) * across + (x >> block)]]
        rest.append(add(p, q, -1))
    o = head(width, height)
    o.put(1, 1)
    o.put(0, 2)
    o.put(block - 2, 3)
    o.image([0xFF000000 | m << 8 for m in modes], across, rng)
    o.put(0, 1)
    o.image(rest, width, rng, "one", 3)
    assert (decode(o.file()) == rgba(pixels, width)).all()


def test_cross_colour_and_subtract_green():
    rng = random.Random(2)
    width, height, block = 21, 17, 3
    pixels = picture(rng, width, height, 60)
    across = -(-width >> block)
    elements = [0xFF000000 | rng.randrange(1 << 24) for _ in range(across * -(-height >> block))]
    int8 = lambda v: v - 256 if v > 127 else v
    delta = lambda t, c: (int8(t) * int8(c)) >> 5
    coded = []
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        a, r, g, b = p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255
        r, b = (r - g) & 255, (b - g) & 255  # the second transform comes off first
        e = elements[(y >> block) * across + (x >> block)]
        b = (b - delta(e >> 8 & 255, g) - delta(e >> 16 & 255, r)) & 255
        r = (r - delta(e & 255, g)) & 255
        coded.append(a << 24 | r << 16 | g << 8 | b)
    o = head(width, height)
    o.put(1, 1)
    o.put(2, 2)
    o.put(1, 1)
    o.put(1, 2)
    o.put(block - 2, 3)
    o.image(elements, across, rng)
    o.put(0, 1)
    o.image(coded, width, rng, "groups", 0)
    assert (decode(o.file()) == rgba(pixels, width)).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palette(colours):
    rng = random.Random(colours)
    width, height = 37, 11
    palette = [rng.randrange(1 << 32) for _ in range(colours)]
    index = [rng.randrange(colours) for _ in range(width * height)]
    packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    across = -(-width >> packed)
    rows = []
    for y in range(height):
        for k in range(across):
            part = index[y * width + (k << packed) : y * width + min(width, (k + 1) << packed)]
            rows.append(0xFF000000 | sum(v << (i * (8 >> packed)) for i, v in enumerate(part)) << 8)
    o = head(width, height)
    o.put(1, 1)
    o.put(3, 2)
    o.put(colours - 1, 8)
    o.image([palette[0]] + [add(palette[i], palette[i - 1], -1) for i in range(1, colours)], colours, rng)
    o.put(0, 1)
    o.image(rows, across, rng, "one", 2)
    assert (decode(o.file()) == rgba([palette[i] for i in index], width)).all()


def test_round_trip_of_the_writer():
    rng = np.random.default_rng(0)
    for h, w, k in ((1, 1, 256), (5, 64, 1), (5, 64, 2), (40, 64, 3), (300, 64, 256), (7, 128, 65)):
        image = rng.integers(0, k, (h, w, 3), dtype=np.uint8)
        assert (decode(encode(image))[..., :3] == image).all()


def test_code_lengths_are_complete_and_short():
    rng = np.random.default_rng(1)
    for counts in (np.array([5]), np.array([0, 3, 9]), rng.integers(0, 50, 280), np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181]), np.zeros(4, np.int64)):
        lengths = webp.code_lengths(counts)
        used = lengths[lengths > 0]
        assert used.max() <= webp.MOST_LENGTH and ((lengths > 0) == (counts > 0))[counts > 0].all()
        assert len(used) == 1 or (2.0**-used).sum() == 1


def test_the_query_goes_through_all_of_the_decoder(monkeypatch):
    """On a whole small table: codes of uneven lengths, references, the cache, and each transform are written and undone."""
    import pyarrow.parquet as pq

    met = {"codes": 0, "references": 0, "cache": 0}

    def seen(name, real, note=lambda a: None):
        def call(*a):
            met[name] = met.get(name, 0) + 1
            note(a)
            return real(*a)

        monkeypatch.setattr(webp, name, call)

    def group(a):
        met["codes"] += any(c.width and len(set(c.lengths.tolist())) > 1 for c in a[1])
        met["cache"] += a[4] > 0
        met["references"] += bool((a[1][0].symbols >= 256).any())

    seen("_one_group", webp._one_group, group)
    seen("_unpredict", webp._unpredict)
    seen("_uncross", webp._uncross)
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist():
        image = image_of(payload_of((text or "").encode()))
        assert (decode(encode(image))[..., :3] == image).all()
    assert min(met.values()) >= 3 and {"_unpredict", "_uncross"} <= set(met)
    kinds = {zlib.crc32(image_of(payload_of(b"t%d" % i)).tobytes()) & 3 for i in range(40)}
    assert kinds == {0, 1, 2, 3}  # the palette for short texts, subtract-green


def test_features(spark):
    image = np.zeros((2, 64, 3), np.uint8)
    image[:, ::2] = (10, 20, 30)
    df = spark.createDataFrame([(1, 384, encode(image))], "doc_id long, n_bytes long, media binary")
    assert media_report(df).first().feature == "64x2:5000:10000:15000:20000"


def test_references_longer_than_the_most_and_texts_of_one_letter():
    for text in (b"abc" * 70_000, b"x" * 50_000, b"abcdefg" * 9_000 + b"!" + b"abcdefg" * 9_000):
        image = image_of(payload_of(text))
        stored = encode(image)
        assert (decode(stored)[..., :3] == image).all() and len(stored) < len(text) // 20


def test_a_huge_image_of_few_bytes_is_an_error():
    one = encode(np.zeros((16384, 64, 3), np.uint8))
    assert len(one) < 5000
    with pytest.raises(ValueError, match="more pixels"):
        decode(one, most_pixels=1 << 16)


def test_broken_files():
    good = encode(np.arange(192, dtype=np.uint8).reshape(1, 64, 3))
    for bad in (b"", b"RIFF", good[:30], good[: len(good) // 2], b"x" + good[1:]):
        with pytest.raises((ValueError, IndexError)):
            decode(bad)


def test_queries_columns(spark):
    texts = [None, "", "a", "a", "é" * 100, "x" * 192, "y" * 193, "long " * 40_000]
    df = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in media_report(to_media(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = payload_of(raw)
        assert len(payload) % 192 == 0 and len(payload) >= max(192, len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = encode(image_of(payload))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert rows[2][1:] == rows[3][1:]
    assert to_media(df.limit(0)).count() == 0


def test_pixel_arrays(spark):
    image = np.arange(192, dtype=np.uint8).reshape(1, 64, 3)
    df = spark.createDataFrame([(1, encode(image)), (2, b"broken"), (3, None)], "error long, media binary").withColumnRenamed("error", "id")
    rows = {r.id: r for r in pixel_arrays(df).collect()}
    assert (rows[1].width, rows[1].height) == (64, 1) and (np.frombuffer(rows[1].pixels, np.uint8).reshape(1, 64, 4)[..., :3] == image).all()
    assert rows[2].pixels is None and rows[2].error and rows[3].error


def test_wide_images_for_long_payloads():
    assert image_of(b" " * 192 * (webp.MOST_SIDE + 1)).shape[1] == 128


@pytest.mark.parametrize("few", [1, 6, 1000])
def test_files_side_by_side(monkeypatch, few):
    """Files of any kind are read as one by one: all in lanes to the end, the last of them one by one, or all."""
    monkeypatch.setattr(webp, "FEW_LANES", few)
    rng, files, wanted = random.Random(5), [], []
    for k in range(24):
        width, height, colours = ((1, 1, 1), (7, 9, 3), (33, 20, 40), (64, 64, 300), (40, 3, 9), (16, 90, 120))[k % 6]
        pixels = picture(rng, width, height, colours)
        if k % 4:  # opaque
            pixels = [p | 0xFF000000 for p in pixels]
        o = head(width, height)
        o.put(0, 1)
        o.image(pixels, width, rng, "groups" if k % 5 == 4 else "one", (0, 3, 11)[k % 3])
        files.append(o.file())
        wanted.append(rgba(pixels, width))
    for text in (b"", b"abc" * 70_000, b"the quick brown fox " * 90, bytes(range(32, 127)) * 40, *(b"%d words and numbers %d\n" % (k, k * k) * (3 + k) for k in range(40))):
        image = image_of(payload_of(text))
        files.append(encode(image))
        wanted.append(np.dstack((image, np.full(image.shape[:2], 255, np.uint8))))
    for got, image in zip(webp.decode_many(files), wanted, strict=True):
        assert got.shape == image.shape and (got == image).all()
    assert list(webp.decode_many([])) == []
    monkeypatch.setattr(webp, "SIDE_BYTES", 3000)
    assert all((got == image).all() for got, image in zip(webp.decode_many(files), wanted, strict=True))
    for bad in (files[-1][: len(files[-1]) // 2], files[-1][:40], b"RIFF"):
        with pytest.raises((ValueError, IndexError)):
            list(webp.decode_many([*files, bad]))


def test_many_images_take_few_calls(monkeypatch):
    """Codes are made for all images together and pixels of all files are followed together; streams are those of one image at a time."""
    import pyarrow.parquet as pq

    calls = {}
    for name in ("_made_codes", "_steps", "_code_at_once"):
        real = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, name=name, real=real: calls.update({name: calls.get(name, 0) + 1}) or real(*a))
    monkeypatch.setattr(webp, "FEW_LANES", 8)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    images = [image_of(payload_of((t or "").encode())) for t in texts]
    files = webp.encode_many(images)
    assert calls["_made_codes"] <= 4
    assert hashlib.sha256(b"".join(files)).hexdigest() == "a2fcf7fde422994391dc6e81d75f732fe8f4cc29e4eb6f628fe8baa76bbf2bc9"  # as the streams were before
    calls.clear()
    assert all((x[..., :3] == y).all() for x, y in zip(webp.decode_many(files), images, strict=True))
    assert calls.get("_steps", 0) < len(files) // 2


def test_groups_of_images_are_one_array(monkeypatch):
    """Not a pass for each image: a group's pixels are searched for copies at once, and images of transforms are read side by side too."""
    import pyarrow.parquet as pq

    calls = dict.fromkeys(("_copies", "_image", "_placed"), 0)
    for name in calls:
        real = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, name=name, real=real: calls.update({name: calls[name] + 1}) or real(*a))
    monkeypatch.setattr(webp, "FEW_LANES", 1)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    images = [image_of(payload_of((t or "").encode())) for t in texts]
    files = webp.encode_many(images)
    assert len(files) == len(texts) and calls["_copies"] <= -(-len(texts) // webp.TOGETHER)
    assert all((x[..., :3] == y).all() for x, y in zip(webp.decode_many(files), images, strict=True))
    assert calls["_image"] == calls["_placed"] == 0


@pytest.mark.parametrize("clash", [False, True])
def test_a_stream_does_not_depend_on_its_group(monkeypatch, clash):
    """Images of all sizes and kinds, in any group: the streams of one image alone, even where hashes of pixels clash."""
    if clash:
        monkeypatch.setattr(webp, "mix", lambda x: x & np.uint64(0x100))
    rng = np.random.default_rng(3)
    images = [rng.integers(0, k, (h, w, 3), dtype=np.uint8) for h, w, k in ((1, 1, 256), (1, 2, 2), (1, 3, 2), (90, 64, 2), (5, 64, 256), (70, 100, 3), (130, 128, 4), (3, 7, 2), (65, 64, 40))]
    images += [image_of(payload_of(t)) for t in (b"", b"a", b"abc" * 5000, b"some words and more words " * 70, *(b"%d then %d\n" % (k, k * k) * (2 + 9 * k) for k in range(40)))]
    alone = [encode(x) for x in images]
    assert webp.encode_many(images) == alone
    assert webp.encode_many(images[::-1]) == alone[::-1]
    monkeypatch.setattr(webp, "TOGETHER", 7)
    assert webp.encode_many(images) == alone
    monkeypatch.setattr(webp, "TOGETHER_PIXELS", 1000)
    assert webp.encode_many(images) == alone and webp.encode_many([]) == []
    monkeypatch.setattr(webp, "FEW_LANES", 3)
    assert all((x[..., :3] == y).all() for x, y in zip(webp.decode_many(alone), images, strict=True))


def test_code_lengths_of_many_are_shortest():
    rng = np.random.default_rng(4)
    every = [rng.integers(0, 40, 60) * rng.integers(0, 2, 60) + (np.arange(60) < 2) for _ in range(30)] + [np.array([1, 1]), np.ones(280, np.int64), 3 ** np.arange(20)]
    lengths = np.split(webp._many_lengths(np.concatenate(every), np.array([len(x) for x in every])), np.cumsum([len(x) for x in every])[:-1])
    for counts, found in zip(every, lengths, strict=True):
        assert (found == webp.code_lengths(counts)).all() and found.max() <= webp.MOST_LENGTH and (2.0 ** -found[counts > 0]).sum() == 1
        heap, cost = counts[counts > 0].tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert int(counts @ found) == cost or len(counts) == 20  # the last would be longer than allowed
