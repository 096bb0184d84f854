"""Tables built once an application and input."""

from ledgerlens.session import files_version, shared


def test_built_once_until_the_files_change(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def get():
        t = spark.read.parquet(path)
        return shared(spark, ("count", path, files_version(t)), lambda: built.append(1) or t.count())

    spark.range(5).write.parquet(path)
    assert [get(), get()] == [5, 5] and len(built) == 1
    spark.range(3).write.mode("append").parquet(path)
    assert get() == 8 and len(built) == 2
    assert shared(spark, ("other", path), lambda: 1) == 1
