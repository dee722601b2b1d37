"""Intermediate tables: where they may be, that queries leave none behind, and queries side by side."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from types import SimpleNamespace

import pytest

from fieldsonar import storage
from fieldsonar.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


def session(master, warehouse, checkpoint=None):
    get = {"spark.checkpoint.dir": checkpoint, "spark.sql.warehouse.dir": warehouse}.get
    conf = SimpleNamespace(get=lambda k, d=None: get(k) or d)
    return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master), conf=conf)


def test_no_local_folder_on_a_cluster():
    assert storage.shared_dir(session("local[4]", "file:/x/w/")) == "file:/x/w/_fieldsonar"
    assert storage.shared_dir(session("yarn", "hdfs://a/w")) == "hdfs://a/w/_fieldsonar"
    assert storage.shared_dir(session("spark://a:7077", "file:/x/w", "file:///shared/")) == "file:///shared"
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(session(master, "file:/x/w"))


def folders(spark):
    top = Path(storage.shared_dir(spark).removeprefix("file:").replace("///", "/"))
    return {p.name for p in top.iterdir()} if top.exists() else set()


pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


@pytest.mark.parametrize("name", ["radius_sweep", "event_ids", "clock_calibration", "anchored_sessions", "exclusive_candidates", "csv_files"])
def test_a_query_leaves_its_result_alone(spark, name):
    before = folders(spark)
    got = QUERIES[name](spark, str(DATA))
    left = folders(spark) - before
    assert len(left) == 1 and next(iter(left)).startswith(name)
    assert got.count() > 0


def test_queries_side_by_side(spark):
    """Neither query deletes what the other still reads."""
    names = ["pair_alignment", "exclusive_candidates", "anchored_sessions", "event_ids"] * 2
    alone = {n: sorted(map(str, QUERIES[n](spark, str(DATA)).collect())) for n in set(names)}
    with ThreadPoolExecutor(4) as pool:
        together = list(pool.map(lambda n: sorted(map(str, QUERIES[n](spark, str(DATA)).collect())), names))
    assert all(got == alone[n] for n, got in zip(names, together))
