import pytest
from pyspark.errors import AnalysisException
from skuflow.sources import versions


def _writer(spark, n):
    def write(path):
        spark.range(n).write.parquet(f"{path}/a")
        if n < 0:
            raise OSError("disk full")
        spark.range(2 * n).write.parquet(f"{path}/b")

    return write


def _sizes(spark, path):
    return spark.read.parquet(f"{path}/a").count(), spark.read.parquet(f"{path}/b").count()


def test_failed_writer_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "models")
    with pytest.raises(AnalysisException):
        versions.current(spark, root)
    first = versions.publish(spark, root, _writer(spark, 3))
    pinned = versions.current(spark, root)
    assert pinned == f"{root}/{first}" and _sizes(spark, pinned) == (3, 6)
    with pytest.raises(OSError, match="full"):
        versions.publish(spark, root, _writer(spark, -1))
    assert versions.current(spark, root) == pinned
    second = versions.publish(spark, root, _writer(spark, 5))
    assert versions.current(spark, root) == f"{root}/{second}"
    assert _sizes(spark, versions.current(spark, root)) == (5, 10) and _sizes(spark, pinned) == (3, 6)
