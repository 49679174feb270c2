"""The shared folder: where it comes from, and how it is emptied."""

import os
from types import SimpleNamespace

import pytest

from strandlake.llm import _common


class Conf(dict):
    def set(self, key, value):
        self[key] = value


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"])
def test_a_cluster_needs_a_shared_folder(master):
    session = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _common.scratch_root(session)
    session.conf["spark.checkpoint.dir"] = "hdfs://shared/here/"
    assert _common.scratch_root(session) == "hdfs://shared/here"


def test_intermediate_tables_can_be_deleted(spark):
    rows = _common.written(spark.range(3), "some")
    assert rows.count() == 3
    root = _common.scratch_root(spark).removeprefix("file:")
    root = "/" + root.lstrip("/")
    assert os.listdir(f"{root}/strandlake")
    _common.clear_scratch(spark)
    assert not os.path.exists(f"{root}/strandlake")
    assert _common.written(spark.range(2), "again").count() == 2
