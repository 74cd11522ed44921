"""What a single task reads of large inputs."""
from pathlib import Path

from suite import scans
from suite.registry import CASES

SF = "/root/testdata/sf0.001"


def test_large_ontology_is_written_as_several_files(spark, monkeypatch):
    """An XML file is read by one task; before, all parts of one partition were one file."""
    made = []
    fresh = scans.fresh
    monkeypatch.setattr(scans, "fresh", lambda *x: made.append(fresh(*x)) or made[-1])
    whole = sorted(map(tuple, CASES["S3_read_ontology"](spark, SF).collect()))
    monkeypatch.setattr(scans, "ENTITIES_PER_FILE", 20, raising=False)
    parts = sorted(map(tuple, CASES["S3_read_ontology"](spark, SF).collect()))
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    files = [len(list(Path(p.removeprefix("file:")).glob("part-*"))) for p in made]
    assert n > 20 and files[1] >= n / 20 > files[0] and parts == whole
