import pytest
from pyspark.sql import functions as F

from tsweave.llm import apart


@pytest.mark.parametrize("keys", [[], [3], list(range(0, 5000, 7))])
def test_rows_without_keys(spark, keys):
    rows = spark.range(5000).withColumn("bit_set", F.lit("x")).unionByName(spark.createDataFrame([(None, "x"), (7, "x")], "id long, bit_set string"))
    rows = rows.withColumnRenamed("bit_set", "other")
    table = spark.createDataFrame([(k,) for k in keys], "id long")
    want = sorted([i for i in range(5000) if i not in set(keys)] + [7] * (7 not in keys))
    got = [r.id for r in apart.without(rows, table, "id").collect()]
    assert sorted(i for i in got if i is not None) == want and got.count(None) == 1
    rest, likely = apart.parted(rows, table, "id")
    assert rest.count() + likely.count() == 5002 and likely.where(F.col("id").isin(keys)).count() == len(keys) + (7 in keys)
