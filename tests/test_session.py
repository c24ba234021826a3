"""Where steps are written that all executors must reach."""

from types import SimpleNamespace

import pytest

from flowlens import session


def cluster(master: str, **conf: str):
    """As much of a session as the choice of the folder looks at."""
    settings = {"spark.sql.warehouse.dir": "file:/shared/warehouse", **conf}
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, applicationId="app"))


@pytest.mark.parametrize("master", ["local-cluster[3,2,1024]", "spark://host:7077", "yarn"])
def test_several_processes_share_the_warehouse(monkeypatch, master):
    """A temporary folder of the driver is no folder of the executors, and a query without a set folder must not end in an error."""
    monkeypatch.setattr(session, "_reaches_all", lambda spark, folder: True)
    assert session.shared_dir(cluster(master)) == "file:/shared/warehouse"


def test_folder_without_scheme(monkeypatch):
    set_to = {"spark.checkpoint.dir": "/tmp/checkpoints/"}
    monkeypatch.setattr(session, "_reaches_all", lambda spark, folder: True)
    assert session.shared_dir(cluster("spark://host:7077", **set_to)) == "/tmp/checkpoints"
    monkeypatch.setattr(session, "_reaches_all", lambda spark, folder: folder != "/tmp/checkpoints")
    assert session.shared_dir(cluster("spark://host:7077", **set_to)) == "file:/shared/warehouse"
    monkeypatch.setattr(session, "_reaches_all", lambda spark, folder: False)
    with pytest.raises(ValueError, match="shared by all executors"):
        session.shared_dir(cluster("spark://host:7077", **set_to))


def test_folder_is_tried(spark, tmp_path):
    assert session._reaches_all(spark, str(tmp_path))
    assert not [*(tmp_path / "flowlens").iterdir()]
    (tmp_path / "file").write_text("")
    assert not session._reaches_all(spark, str(tmp_path / "file"))  # no folder can be made below a file
