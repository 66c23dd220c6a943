import pytest
from pyspark import SparkConf, SparkContext

from compare import connection, difference
from rosterlink import durable
from rosterlink.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"

# Queries that store a table in the shared folder when the roster is too large for a broadcast.
STORING = (
    "export_lines export_view facet_counts facet_rows facet_states facet_status facet_values kept_counts kept_summary "
    "kept_view link_count lookup_anti lookup_gaps lookup_inner lookup_left lookup_semi nearest_name"
).split()


@pytest.fixture
def cluster(spark, tmp_path, monkeypatch):
    """A session whose master is no local one; its checkpoint folder is a ``file:`` path."""
    monkeypatch.setattr(SparkContext, "getCheckpointDir", lambda self: f"file:{tmp_path}")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(durable, "_TRIED", {}, raising=False)
    return spark


def test_file_folder_that_a_cluster_shares(cluster, tmp_path):
    assert durable.shared_folder(cluster) == f"file:{tmp_path}"
    assert not list(tmp_path.glob("try-*"))
    assert durable.stored(cluster.range(10)).count() == 10


@pytest.mark.parametrize("name", ["manifest_gaps", "lookup_reduced", "named_files"])
def test_queries_on_a_cluster(cluster, name):
    assert QUERIES[name](cluster, FOLDER).count() > 0


@pytest.mark.parametrize("name", STORING)
def test_queries_of_a_large_roster_on_a_cluster(cluster, monkeypatch, name):
    """All of their tables go to a ``file:`` folder that the machines share."""
    monkeypatch.setattr(durable, "_MADE", [])
    before = cluster.conf.get("spark.sql.autoBroadcastJoinThreshold")
    cluster.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        assert difference(cluster, connection(FOLDER), FOLDER, name) == ""
    finally:
        cluster.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert durable._MADE and all(path.startswith(durable.shared_folder(cluster)) for path in durable._MADE)


def test_warehouse_that_a_cluster_shares(cluster, monkeypatch):
    monkeypatch.setattr(SparkContext, "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(SparkContext, "getConf", lambda self: SparkConf(False))
    assert durable.shared_folder(cluster).endswith("/_work")


def test_file_folder_of_each_machine_is_refused(cluster, tmp_path, monkeypatch):
    """Half of the written files are on other disks."""
    reader = type(cluster.read)
    read = reader.parquet
    monkeypatch.setattr(reader, "parquet", lambda self, *paths: read(self, *paths).filter("id % 2 = 0"))
    with pytest.raises(ValueError, match="do not share"):
        durable.shared_folder(cluster)
