from types import SimpleNamespace

import pytest

from modelwatch import session


def test_cluster_without_shared_folder_is_refused():
    cluster = SimpleNamespace(
        sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None),
        conf=SimpleNamespace(get=lambda key, default: default),
    )
    with pytest.raises(RuntimeError, match="shared by all executors"):
        session.shared_path(cluster, "x")


def test_paths_are_fresh_and_below_the_configured_folder():
    configured = SimpleNamespace(
        sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None),
        conf=SimpleNamespace(get=lambda key, default: "s3a://bucket/ckpt/"),
    )
    one, two = session.shared_path(configured, "x"), session.shared_path(configured, "x")
    assert one != two and one.startswith("s3a://bucket/ckpt/modelwatch/x-")


def test_materialised_frames_keep_their_rows(spark):
    df = spark.range(100, numPartitions=5)
    kept = session.materialise(df)
    assert kept.count() == 100 and kept.schema == df.schema
