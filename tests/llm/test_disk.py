"""What operators leave on disk while they run."""

import os
import time

from placegrid.llm import components
from placegrid.session import materialize, shared_dir


def _shuffle_files(spark) -> set[str]:
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    names = set()
    while found.hasNext():
        names.add(found.next().getName())
    return {name for name in names if name.startswith("shuffle_")}


def test_a_written_stage_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    rows = materialize(spark.range(10_000).selectExpr("id % 97 AS k").groupBy("k").count())
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert rows.count() == 97


def test_rounds_of_components_leave_one_small_table(spark):
    folder = f"{shared_dir(spark).removeprefix('file://')}/placegrid"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = components.roots(spark.range(1, 300).selectExpr("id AS u", "id - 1 AS v"))
    assert {(r.node, r.root) for r in found.collect()} == {(k, 0) for k in range(1, 300)}
    assert len(set(os.listdir(folder)) - before) == 1
    assert len(found.inputFiles()) == 1
