from pyspark.sql import functions as F

from propspark.operators import cleaning
from propspark.session import intermediates, materialize


def test_intermediates_go_with_their_block(spark):
    df = spark.range(40).select("id", (F.col("id") % 7).cast("double").alias("x"))
    outer = materialize(df)
    with intermediates(spark):
        inner = materialize(df)
        paths = inner.inputFiles()
        assert cleaning.clean(df, required_columns=["x"], handle_missing="impute", outlier_method="iqr").count() == 40
    hadoop = spark._jsc.hadoopConfiguration()
    left = [p for p in paths if (at := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(hadoop).exists(at)]
    assert not left and outer.count() == 40
