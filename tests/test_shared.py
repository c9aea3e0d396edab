"""The folder that executors share."""

import types

import pytest

from quern import shared


def fake(master, told=None):
    context = types.SimpleNamespace(master=master, applicationId=f"test-{master}", getConf=lambda: types.SimpleNamespace(get=lambda name: None))
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda name, default=None: told), sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(fake(master))
    assert shared.shared_dir(fake(master, "hdfs://x/y/")) == "hdfs://x/y"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_one_process_has_a_folder_of_its_own(master):
    assert shared.shared_dir(fake(master)).startswith("file:///")


def test_dropped(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    shared.dropped(spark, path)
    assert not (tmp_path / "t").exists()
