from bisect import bisect_left

from pyspark.sql import functions as F

from veilspark.llm._spark import edges_below


def test_edges_below_counts(spark):
    values = [-5.5, 0.0, 1.0, 2.5, 7.0, 99.0, 1000.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for n in (0, 1, 2, 5, 9, 10, 100, 255):
        edges = [float(i) for i in range(n)]
        assert [r[0] for r in df.select(edges_below(F.col("v"), edges)).collect()] == [bisect_left(edges, v) for v in values]
    whole = [3, 5, 2**62]
    assert [r[0] for r in spark.range(3, 7).select(edges_below(F.col("id"), whole)).collect()] == [bisect_left(whole, v) for v in range(3, 7)]
