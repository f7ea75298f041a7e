"""Landed payloads of the scheduler's query: more detections are more files, not longer ones."""

import glob
import os
from pathlib import Path

import pytest

from plumeline.operators.graph import shared_dir
from plumeline.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_landed_files_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(queries, "LANDED", 20, raising=False)
    base = shared_dir(spark).removeprefix("file:").rstrip("/")
    before = set(glob.glob(f"{base}/schedule-*"))
    row = queries.QUERIES["schedule_once"](spark, DATA).first()
    (made,) = set(glob.glob(f"{base}/schedule-*")) - before
    texts = [Path(f).read_text() for f in glob.glob(f"{made}/landed/nasa_firms/part-*")]
    n = spark.read.parquet(f"{DATA}/events.parquet").count()
    assert row.n == 2 * n and sum(t.strip().count("\n") for t in texts) == n
    assert all(t.count("latitude") == 1 for t in texts) and max(t.count("\n") for t in texts) < 60
