"""Where intermediate tables go, with and without the setting."""

from types import SimpleNamespace

import pytest

from brinkline.plans.shared import shared_root


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_the_setting_is_used():
    a, b = (shared_root(session("spark://host:7077", "hdfs://store/shared/")) for _ in range(2))
    assert a != b and a.startswith("hdfs://store/shared/brinkline-")


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]"])
def test_local_sessions_have_a_folder_of_their_own(master):
    a, b = (shared_root(session(master)) for _ in range(2))
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "yarn", "k8s://host", "spark://host:7077"])
def test_clusters_must_set_it(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(session(master))
