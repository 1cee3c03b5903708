from pyspark.sql import functions as F

from quarry.functions.text import tokenize
from quarry.operators import retrieval
from quarry.plans import queries
from tests.conftest import SF


def test_rows_that_share_a_key_or_have_none_stay_apart(spark):
    rows = spark.createDataFrame([(None, "apple"), (None, "pear"), (1, "apple pear"), (1, "apple"), (2, "plum")], "id long, text string").select("id", tokenize(F.col("text")).alias("words"))
    got = retrieval.keyword_retrieve(rows, ["apple", "pear"], "id", 10, least=0.1).collect()
    assert sorted((str(r.id), r.score) for r in got) == [("1", 0.5), ("1", 1.0), ("None", 0.5), ("None", 0.5)]


def test_candidates_count_without_a_vector_too(spark):
    """300 rows with vectors, 40 without; 5 of the former and all of the latter are candidates: 45 are enough for two phases."""
    rows = [(i, ["apple"] if 5 <= i < 8 or i >= 298 else ["other"], [1.0, 0.0] if i >= 3 and i < 298 else [0.9, 0.1]) for i in range(300)]
    rows += [(1000 + i, ["apple"], None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, words array<string>, embedding array<double>")
    got = retrieval.two_phase(df, [1.0, 0.0], ["apple"], "id", 3).collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [(5, 1.0), (6, 1.0), (7, 1.0)]
    few = retrieval.two_phase(df.where("id < 1010"), [1.0, 0.0], ["apple"], "id", 3).collect()  # 15 candidates: too few
    assert [r.id for r in few] == [3, 4, 5]


def test_memories_by_similarity_or_else_by_keywords(spark):
    rows = [(1, ["garden"], "2024-01-01", [1.0, 0.0]), (2, ["garden"], "2024-01-02", [0.0, 1.0]), (3, ["other"], "2024-01-03", None)]
    df = spark.createDataFrame(rows, "id long, words array<string>, created_at string, embedding array<double>").withColumn("created_at", F.col("created_at").cast("timestamp"))
    now = F.lit("2024-01-05").cast("timestamp")
    find = lambda v, w: [r.id for r in retrieval.memory_retrieve(df, v, w, now, "id").collect()]
    assert find([1.0, 0.0], ["garden"]) == [1] and find([-1.0, 0.0], ["garden"]) == [2, 1] and find(None, ["garden"]) == [2, 1] and find([-1.0, 0.0], []) == []


def test_only_words_that_can_match_cross_a_join(spark):
    """Narrowed rows answer as whole ones, and have only words that are equal to the question's or begin like them."""
    rows = spark.createDataFrame([(1, ["garden", "gardener", "winter", "of"]), (2, ["gard", "house"]), (3, None)], "id long, words array<string>")
    near = retrieval.narrowed(rows, ["gardens", "of"])
    assert [r.words for r in near.orderBy("id").collect()] == [["garden", "gardener", "of"], [], None]
    score = lambda df: [(r.id, r.score) for r in retrieval.keyword_scored(df, ["gardens", "of"], "score").orderBy("id").collect()]
    assert score(near) == score(rows)
    for name in ("retrieve_with_vector", "two_phase_small_domain", "two_phase_retrieve"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        made = [line for line in plan.splitlines() if "split(lower(" in line]
        assert made and all("substring(" in line and "Project" in line for line in made), name  # the words are narrowed where they are made
