from types import SimpleNamespace

import pytest

from textloom.plans import lineage


def test_shared_folder():
    """A cluster needs spark.checkpoint.dir; a local session gets a folder of its own where it is unset."""
    session = lambda master, folder=None: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder or default), sparkContext=SimpleNamespace(master=master))
    assert lineage.shared_folder(session("spark://h:7077", "hdfs:///x")) == "hdfs:///x"
    assert lineage.shared_folder(session("local[2]")) == lineage.shared_folder(session("local[*]"))
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError):
            lineage.shared_folder(session(master))
