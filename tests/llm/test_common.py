"""Scratch tables of the operators."""

import os

from pyspark.sql import functions as F

from tessera.llm.common import cut, discard

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_cut_and_discard(spark):
    before = spark.conf.get(CLEANUP)
    one = cut(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert spark.conf.get(CLEANUP) == before
    two = cut(one.where("k < 3"))
    folder = os.path.dirname(one.inputFiles()[0].removeprefix("file://").removeprefix("file:"))
    assert os.path.isdir(folder)
    discard(one, None, one, spark.range(1))  # twice, and tables that are not its own, do no harm
    assert not os.path.exists(folder)
    assert two.count() == 3 and {r["k"] for r in two.collect()} == {0, 1, 2}
