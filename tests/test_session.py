"""Scratch space rules: the cluster's spark.checkpoint.dir is used when set;
a private /tmp folder only in local mode; otherwise an error."""
import pytest

from claimwise import session


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _SC:
    def __init__(self, master, current=None):
        self.master, self.current, self.set_to = master, current, None

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.set_to = path
        self.current = path


class _Spark:
    def __init__(self, master, conf=None, current=None):
        self.sparkContext = _SC(master, current)
        self.conf = _Conf(conf or {})


def test_cluster_without_checkpoint_dir_is_an_error():
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(_Spark("yarn"))


def test_cluster_uses_configured_dir():
    s = _Spark("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert session.checkpoint_dir(s) == "hdfs:///shared/ckpt"


def test_existing_checkpoint_dir_wins():
    s = _Spark("k8s://x", {"spark.checkpoint.dir": "s3://other"}, current="s3://bucket/ckpt/uuid")
    assert session.checkpoint_dir(s) == "s3://bucket/ckpt/uuid"


def test_local_mode_gets_private_tmp_folder():
    s = _Spark("local[2]")
    path = session.checkpoint_dir(s)
    assert path.startswith("/tmp/claimwise-ckpt-")
