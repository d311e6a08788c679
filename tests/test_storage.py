import time

from pyspark.sql import functions as F

from tidewright.functions import storage


def _shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "shuffle_" in f}


def _exists(spark, df):
    place, files = storage._place(spark, df.select(F.input_file_name()).distinct().first()[0].rsplit("/", 1)[0])
    return lambda: files.exists(place)


def test_shuffle_files_go_with_the_write(spark):
    before = _shuffled(spark)
    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    kept = spark.conf.get(storage.CLEANUP)
    assert storage.stored(df, "counts").count() == 100
    assert spark.conf.get(storage.CLEANUP) == kept
    for _ in range(50):
        left = [f for f in _shuffled(spark) - before if f.endswith(".data")]
        if len(left) <= 1:  # that of the last count
            break
        time.sleep(0.2)
    assert len(left) <= 1


def test_scratch_tables_go_with_their_scope(spark):
    with storage.scratch():
        with storage.scratch():
            inner = storage.stored(spark.range(5), "inner")
            gone = _exists(spark, inner)
            outer = storage.stored(inner, "outer", out=True)
            there = _exists(spark, outer)
            assert gone() and there()
        assert not gone() and there() and outer.count() == 5
    assert not there()
    assert storage.stored(spark.range(3), "free").count() == 3
