import random

from quarry.llm.line_dedup import LineDedup, dedup_lines


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    few, many = sorted((a, b), key=len)
    return len(many) == len(few) + 1 and any(many[:i] + many[i + 1 :] == few for i in range(len(many)))


def plain(docs, p):
    lines = [(i, k, x, x.lower().split()) for i, t in docs for k, x in enumerate((t or "").split("\n"))]
    lines.sort(key=lambda x: x[:2])
    seen, out = [], {i: [] for i, _ in docs}
    for i, _, x, w in lines:
        gone = len(w) >= p.min_words and any(w == v or (len(w) >= p.fuzzy_words and len(v) >= p.fuzzy_words and near(w, v)) for v in seen)
        if len(w) >= p.min_words:
            seen.append(w)
        if not gone:
            out[i].append(x)
    return {i: None if t is None else "\n".join(out[i]) for i, t in docs}


def test_equals_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(60)}" for _ in range(n)] for n in (2, 3, 7, 8, 8, 9, 12, 13, 30)]
    docs = [(100, None), (101, ""), (102, "\n\n"), (103, "A b  C\na B c\n x")]
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + [f"n{rng.randrange(9)}"] + w[k:], w[:k] + [f"n{rng.randrange(9)}"] + w[k + 1 :]]) or ["x"]
            lines.append(rng.choice([" ", "  ", "\t"]).join(w).replace("w1", rng.choice(["w1", "W1"])))
        docs.append((i, "\n".join(lines)))
    docs.append((104, "\n".join(f"Page {k} of this very long book by me and you" for k in range(300))))  # one hot variant
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_lines int, pos string")
    p = LineDedup()
    rows = dedup_lines(df, p).collect()
    assert {r.doc_id: r.text for r in rows} == plain(docs, p)
    by = {r.doc_id: r for r in rows}
    assert (by[100].n_lines, by[100].n_dropped, by[104].n_lines, by[104].n_dropped) == (1, 0, 300, 299) and by[0].pos == "x"


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_an_id_or_with_a_shared_one(spark):
    two = "one two three\none two three"
    df = spark.createDataFrame([(None, two), (None, None), (1, two), (1, two), (1, "four five six\n" + two)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in dedup_lines(df).collect()), key=repr)
    kept = [x for _, t, _, _ in got if t for x in t.split("\n")]
    assert sorted(kept) == ["four five six", "one two three"]
    assert [(i, n, gone) for i, _, n, gone in got if i is None] == [(None, 2, 2), (None, 1, 0)] and sum(n for _, _, n, _ in got) == 10


def test_a_line_of_very_many_words(spark):
    line = [f"w{i}" for i in range(20_000)]
    rows = [(1, " ".join(line)), (2, " ".join(line[:15_000] + ["other"] + line[15_001:])), (3, " ".join(line[:700] + line[701:])), (4, " ".join(line[:5] + line[7:]))]
    got = {r.doc_id: r.n_dropped for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_columns_of_any_name_come_back(spark):
    rows = [(1, "a b c\nx", "keepme", 1, "l", 5), (1, "a b c\ny", "too", 2, "m", 6), (None, None, "three", 3, "n", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, named string, __keep int, __lines string, n_lines int")
    got = dedup_lines(docs).collect()
    assert dedup_lines(docs).columns == ["doc_id", "text", "named", "__keep", "__lines", "n_lines", "n_dropped"]
    assert sorted((r["named"], r["__keep"], r["__lines"]) for r in got) == [("keepme", 1, "l"), ("three", 3, "n"), ("too", 2, "m")]
    unique = dedup_lines(spark.createDataFrame([(1, "a b c", "keepme", 9)], "doc_id long, text string, named string, others int")).first()
    assert (unique.named, unique.others) == ("keepme", 9)
