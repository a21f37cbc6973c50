from pyspark.sql import functions as F

from forgepulse.functions import events as E
from forgepulse.queries import raw_events


def test_raw_events_are_dealt_to_all_cores(spark, small):
    assert raw_events(spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_each_part_has_the_parts_of_a_description(spark):
    rows = spark.createDataFrame([(1, "<user{a}{1}> x <quote{q}> <link{l}{u}>"), (2, "none")], "id long, details string")
    want = rows.select("id", F.explode(E.markup_parts(F.col("details"))).alias("p")).collect()
    assert sorted(E.each_part(rows).collect()) == sorted(want) and len(want) == 3
