"""Edit distance of long token lists and texts, against plain Python; the SQL function gives the same."""

import random
import time

import pytest
from pyspark.sql import functions as F

from parlance.functions import align, sql


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def distances(spark, rows):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, h array<string>, r array<string>")
    sql.register(spark)
    got = df.select("i", align.token_edit_distance(F.col("h"), F.col("r")).alias("d"), F.expr("token_edit_distance(h, r)").alias("s")).orderBy("i").collect()
    assert [r.d for r in got] == [r.s for r in got]
    return [r.d for r in got]


def test_random_lists(spark):
    r = random.Random(1)
    rows = []
    for size in (0, 1, 3, 20, 90, 300, 700):
        for kinds in (2, 40, 5000):
            a = [f"w{r.randrange(kinds)}" for _ in range(size)]
            b = list(a)
            for _ in range(r.choice((0, 2, size // 3))):
                if b:
                    b[r.randrange(len(b)) :][:1] = []
                    b[r.randrange(len(b))] = f"w{r.randrange(kinds)}"
            rows += [(a, b), (b[::-1], a), (a[: size // 4], b)]
    assert distances(spark, rows) == [edits(a, b) for a, b in rows]


def test_more_words_than_letters_below_the_surrogates(spark):
    """60,000 different shared words: places beyond the surrogates, exact."""
    words = [f"w{i}" for i in range(60_000)]
    changed = words[1:] + words[:1]
    for i in (5, 20_000, 54_784, 54_785, 59_999):
        changed[i] = f"new{i}"
    df = spark.createDataFrame([(words, changed)], "h array<string>, r array<string>")
    assert df.select(align.token_edit_distance(F.col("h"), F.col("r")).alias("d")).first().d == 6


def test_long_similar_texts(spark):
    r = random.Random(2)
    a = [f"w{r.randrange(8000)}" for _ in range(20_000)]
    b = list(a)
    for i in r.sample(range(20_000), 50):
        b[i] = f"x{i}"
    df = spark.createDataFrame([(a, b)], "h array<string>, r array<string>").cache()
    df.count()
    # the first run compiles
    for _ in range(2):
        began = time.time()
        assert df.select(align.token_edit_distance(F.col("h"), F.col("r")).alias("d")).first().d == 50
    print("20,000 words, 50 edits:", time.time() - began)
    assert time.time() - began < 15


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 257, 3000])
def test_text_distance(spark, n):
    r = random.Random(n)
    a = "".join(r.choices("aé語😀", k=n))
    b = "".join(r.choice("aé語😀x") if r.random() < 0.1 else x for x in a)[r.randrange(3) :]
    rows = [(a, b), (b, a), (a, ""), (a, a), (None, a), (a, None)]
    got = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a string, b string").select("i", align.distance(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == [None if x is None or y is None else edits(x, y) for x, y in rows]
