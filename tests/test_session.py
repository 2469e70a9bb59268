"""Where intermediate tables go, and that they can be deleted."""

import os
from types import SimpleNamespace

import pytest

from tessera import session


def fake(master, conf=None, given=None):
    """What shared_dir() asks of a session."""
    settings = {}
    option = SimpleNamespace(isDefined=lambda: given is not None, get=lambda: given)
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k, d: conf or d), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option)))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=settings.get, set=settings.__setitem__))


def test_the_cluster_names_the_folder():
    assert session.shared_dir(fake("spark://m:7077", "hdfs://n/c/")) == "hdfs://n/c"
    assert session.shared_dir(fake("yarn", None, "s3a://b/d")) == "s3a://b/d"
    assert session.shared_dir(fake("local[4]", "file:///c")) == "file:///c"


def test_no_folder_of_one_machine_on_a_cluster():
    for master in ("spark://m:7077", "yarn", "k8s://x"):
        with pytest.raises(RuntimeError):
            session.shared_dir(fake(master))


def test_a_local_master_gets_one_folder():
    s = fake("local[2]")
    assert session.shared_dir(s).startswith("file:///") and session.shared_dir(s) == session.shared_dir(s)


def test_written_tables_can_be_deleted(spark):
    df = session.materialise(spark.range(5).toDF("x"), "some")
    folder = session._written(spark).removeprefix("file://")
    assert df.count() == 5 and os.listdir(folder)
    session.discard(spark)
    assert not os.path.exists(folder)
    assert session.materialise(spark.range(3).toDF("x"), "more").count() == 3
