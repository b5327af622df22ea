import pytest

from strandloom import session


class _Context:
    """What checkpoint_dir asks of a SparkContext."""

    def __init__(self, master: str, named: str | None) -> None:
        self.master, self.named, self.set = master, named, None
        self._jsc = self

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isDefined(self) -> bool:
        return self.set is not None

    def get(self, _name: str | None = None):
        return self.named if _name else self.set

    def getConf(self):
        return self

    def setCheckpointDir(self, folder: str) -> None:
        self.set = folder


class _Session:
    def __init__(self, *a) -> None:
        self.sparkContext = _Context(*a)


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://h:7077", "yarn", "k8s://x", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            session.checkpoint_dir(_Session(master, None))
        assert session.checkpoint_dir(_Session(master, "hdfs://shared/x")) == "hdfs://shared/x"
    assert session.checkpoint_dir(_Session("local[8]", "/named")) == "/named"
    assert "strandloom-" in session.checkpoint_dir(_Session("local[8]", None)) and "strandloom-" in session.checkpoint_dir(_Session("local", None))
