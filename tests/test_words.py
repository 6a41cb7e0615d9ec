import random

from pyspark.sql import functions as F

from ratelab.functions.words import text_error_rate, token_edit_distance


def plain_distance(a, b):
    table = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (x != y))
    return table[-1][-1]


def test_edit_distance_against_a_table(spark):
    rng = random.Random(3)
    words = ["a", "b", "cc", "the", "end"]
    pairs = [([rng.choice(words) for _ in range(rng.randint(0, 9))], [rng.choice(words) for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    rows = df.orderBy("i").select(
        token_edit_distance(F.col("a"), F.col("b")).alias("coded")
    ).collect()
    want = [plain_distance(a, b) for a, b in pairs]
    assert [r.coded for r in rows] == want


def test_long_texts_with_many_distinct_words(spark):
    a = [f"w{i}" for i in range(3000)]
    b = a[:100] + ["x"] + a[101:2990]
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(token_edit_distance(F.col("a"), F.col("b"))).first()[0] == 11


def test_more_words_than_points_below_the_surrogates(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("a"))
    df = df.withColumn("b", F.array(F.lit("w59999"), F.lit("w60000"), F.lit("new")))
    assert df.select(token_edit_distance(F.col("a"), F.col("b"))).first()[0] == 59_998 + 1


def test_error_rate_edges(spark):
    cases = [
        ("", "some words", (0.0, 0, 0, 2)), ("a b", "", (1.0, 2, 2, 0)), ("Same, text!", "same text", (0.0, 0, 2, 2)),
        ("one two three", "one three", (1 / 3, 1, 3, 2)), ("123", "x", (0.0, 0, 0, 1)), ("a a a", "a", (2 / 3, 2, 3, 1)),
    ]
    df = spark.createDataFrame([(i, r, h) for i, (r, h, _) in enumerate(cases)], "i int, r string, h string")
    rows = df.orderBy("i").select(text_error_rate(F.col("r"), F.col("h")).alias("w")).collect()
    assert [tuple(r.w) for r in rows] == [c[2] for c in cases]
