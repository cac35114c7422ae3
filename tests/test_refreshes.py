"""Derived tables are replaced as a whole."""

from modelwatch.sinks import tables as sinks
from modelwatch.sources import files


def test_readers_during_two_refreshes_see_one_whole_version(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(0, 50, 1, 5), path)
    first = files.read_latest(spark, path)
    sinks.replace_table(spark.range(100, 170, 1, 7), path)
    second = files.read_latest(spark, path)
    assert first.count() == 50 and second.count() == 70
    spark.range(3).write.parquet(f"{path}/refresh=9223372036854775807")  # a refresh that died before its pointer
    assert files.read_latest(spark, path).count() == 70
    for n in (1, 2):
        sinks.replace_table(spark.range(n), path)
    assert files.read_latest(spark, path).count() == 2
    assert len(files.current_versions(spark, path)) == 2
    assert sorted(f.name for f in (tmp_path / "t").iterdir() if f.name.startswith("refresh=")) == sorted(
        [f"refresh={v}" for v in files.current_versions(spark, path)] + ["refresh=9223372036854775807"]
    )
