"""Where materialised results go."""

import pytest

from foliospark import session as X


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, named=None, folder=None):
        self.sparkContext, self.conf = Context(master, folder), {"spark.checkpoint.dir": named}


def test_checkpoint_folder():
    for master in ("local-cluster[3,2,1024]", "yarn", "spark://h:7077", "k8s://h"):
        with pytest.raises(RuntimeError):
            X.ensure_checkpoint_dir(Session(master))
        s = Session(master, "hdfs:///shared")
        X.ensure_checkpoint_dir(s)
        assert s.sparkContext.folder == "hdfs:///shared"
    s = Session("local[4]")
    X.ensure_checkpoint_dir(s)
    assert "foliospark-ckpt-" in s.sparkContext.folder
    s = Session("yarn", None, "hdfs:///set")
    X.ensure_checkpoint_dir(s)
    assert s.sparkContext.folder == "hdfs:///set"
