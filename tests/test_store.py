"""Written tables: how they are joined."""

from pyspark.sql import functions as F

from lexmill.operators.store import stored


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_stored_tables_are_not_broadcast_by_the_size_of_their_files(spark):
    a, b = (stored(spark.range(n).withColumn("word", F.col("id").cast("string"))) for n in (2000, 1000))
    met = a.where("id > 5").join(b.select("word").distinct(), "word")
    assert "BroadcastHashJoin" not in plan(met) and met.count() == 994
    assert "BroadcastHashJoin" not in plan(a.join(b.select("id"), "id", "left_anti"))
    assert "BroadcastHashJoin" in plan(a.join(F.broadcast(b), "id"))
