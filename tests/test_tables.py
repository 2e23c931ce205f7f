"""Intermediate tables in the shared folder."""

import pytest

from bitloom.sources import tables as T


class Cluster:
    """A session of a cluster that names no shared folder."""

    class conf:  # noqa: N801
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:  # noqa: N801
        master, applicationId = "yarn", "app-1"


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        T.shared_dir(Cluster)


def test_a_local_session_gets_one_of_its_own(monkeypatch):
    monkeypatch.setattr(Cluster.sparkContext, "master", "local[2]")
    assert T.shared_dir(Cluster) == T.shared_dir(Cluster) and T.shared_dir(Cluster).startswith("file:")


def test_tables_lie_below_the_folder_of_the_application(spark):
    kept = T.keep(spark.range(5).withColumnRenamed("id", "a"), "five")
    assert sorted(r["a"] for r in kept.collect()) == list(range(5))
    assert all(f"/bitloom-{spark.sparkContext.applicationId}/five-" in f for f in kept.inputFiles())
