import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators.numbering import earlier_values, number_within


def skewed(spark):
    """A third of the rows in one group, with many equal scores, and a null group."""
    rng = random.Random(1)
    data = [(7 if i % 3 == 0 else (None if i % 50 == 1 else i % 40), rng.choice([0.0, 1.0, 1.0, 2.5]), i) for i in range(3000)]
    return spark.createDataFrame(data, "g int, score double, id long")


def order():
    return [F.col("score").desc(), F.col("id").asc()]


def test_hot_groups_are_numbered_like_the_others(spark, rows):
    df = skewed(spark)
    want = df.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy(*order())).cast("long"))
    assert rows(number_within(df, ["g"], {"n": order()}, hot_rows=100)) == rows(want)
    assert rows(number_within(df, ["g"], {"n": order()})) == rows(want)


def test_all_groups_hot_and_null_group_hot(spark, rows):
    df = skewed(spark)
    want = df.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy(*order())).cast("long"))
    assert rows(number_within(df, ["g"], {"n": order()}, hot_rows=1)) == rows(want)


def test_two_orders_at_once(spark, rows):
    df, by_id = skewed(spark), [F.col("id").desc()]
    want = df.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy(*order())).cast("long")).withColumn(
        "m", F.row_number().over(W.partitionBy("g").orderBy(*by_id)).cast("long")
    )
    assert rows(number_within(df, ["g"], {"n": order(), "m": by_id}, hot_rows=100)) == rows(want)


def test_one_group_of_all_rows(spark, rows):
    df = skewed(spark)
    want = rows(df.withColumn("n", F.row_number().over(W.orderBy(*order())).cast("long")))
    assert rows(number_within(df, [], {"n": order()}, hot_rows=100)) == want
    assert rows(number_within(df, [], {"n": order()}, hot_rows=3000)) == want


def test_earlier_values(spark, rows):
    df = skewed(spark).withColumn("t", F.concat(F.lit("t"), "id")).drop("score")
    names = {3: "c", 2: "b", 1: "a"}
    cold = earlier_values(df, ["g"], ["id"], "t", names)
    hot = earlier_values(df, ["g"], ["id"], "t", names, hot_rows=100)
    assert rows(hot) == rows(cold)
    assert hot.where("c = '' and a <> ''").count() > 0
