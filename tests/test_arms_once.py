from pyspark.sql import functions as F

from skerry.operators import arms


def test_neighbours_are_searched_once(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i * i % 11)], float(i), i % 3) for i in range(40)], "vec_id long, embedding array<double>, y double, label int").withColumn("fold", F.col("vec_id") % 5)
    found = arms.predicted(rows, "fold", 3)
    out = arms.held_out(rows, 3, 2, F.col("vec_id") % 2 == 0, 9)
    assert found.count() == 40 and all("CoGroup" not in d._jdf.queryExecution().toString() for d in (found, out))  # later steps read a kept table
