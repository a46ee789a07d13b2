from pyspark.sql import functions as F

from veristrata.functions import text as T


def values(spark, expr, rows):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_tokens_split_at_marks(spark):
    assert values(spark, T.tokens, ["ताज महल", "été x_1", ""]) == [["त", "ज", "महल"], ["été", "x_1"], []]


def test_shingles(spark):
    assert values(spark, T.char_shingles, ["", "abc", "abcde", "aaaaaaa"]) == [[], ["abc"], ["abcde"], ["aaaaa"]]


def test_scripts(spark):
    assert values(spark, T.dominant_script, ["ab", "hello नम", "नमस्ते", "ਸਤਿ ਸ੍ਰੀ", "12"]) == ["latn", "latn", "deva", "guru", "latn"]


def test_publisher(spark):
    assert values(spark, T.publisher, ["https://www.Example.org/a?b", "http://x.y#z"]) == ["example.org", "x.y"]
