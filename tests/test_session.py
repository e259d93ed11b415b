"""The shared folder is read from the session; a folder of our own only when unset."""

from intentloom import session


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default


class _Ctx:
    def __init__(self, d):
        self.d = d

    def getCheckpointDir(self):
        return self.d

    def setCheckpointDir(self, d):
        self.d = d


class _Spark:
    def __init__(self, conf_value, ctx_dir):
        self.conf = _Conf(conf_value)
        self.sparkContext = _Ctx(ctx_dir)


def test_reads_cluster_setting():
    s = _Spark("hdfs://shared/ckpt", "hdfs://shared/ckpt/abc")
    assert session.checkpoint_root(s) == "hdfs://shared/ckpt"
    assert session.shared_dir(s, "x").startswith("hdfs://shared/ckpt/intentloom/x-")


def test_unset_gets_own_folder_without_touching_conf():
    s = _Spark(None, None)
    root = session.checkpoint_root(s)
    assert root.startswith("/") and s.sparkContext.getCheckpointDir() == root


def test_unset_on_a_cluster_is_refused():
    import pytest
    s = _Spark(None, None)
    s.conf.get = lambda key, default=None: "spark://host:7077" if key == "spark.master" else default
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(s)
