"""Hot keys are told from others by steps of their numbers of rows: however many there are, the driver gets a count a step."""

from pyspark.sql import functions as F

from clausewright.llm import common as C


def test_bound_of_hot_keys(spark):
    sizes = [501, 600, 700, 1000, 4000, 4000, 90000]
    hot = spark.createDataFrame(list(enumerate(sizes)), "k long, n long")
    assert C._hot_limit(hot) == C.HOT and C._hot_limit(hot.where("n < 0")) is None
    for most in range(1, 8):
        limit = C._hot_limit(hot, most)
        dealt = sum(n > limit for n in sizes)
        assert dealt <= most and limit <= 2 ** 0.25 * max([C.HOT, *sorted(sizes)[: len(sizes) - most]]) + 1


def test_dealt_keys_join_alike(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT", 3)
    left = spark.range(200).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), "id").cache()
    right = spark.range(9).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    told = lambda rows: sorted(map(tuple, rows.select("k", "id", "v").collect()))
    plain = told(left.join(right, "k"))
    for many in (100, 2):
        monkeypatch.setattr(C, "MANY", many)
        assert told(C.salted_join(left, right, "k", "id")) == plain
