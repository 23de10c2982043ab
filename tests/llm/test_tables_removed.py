"""Intermediate tables go once what was made of them is written."""

from pathlib import Path

from quern.llm import _shared
from quern.llm.components import components


def test_dropped_tables_are_gone_and_others_stay(spark):
    kept, gone = (_shared.settle(spark.range(3), name) for name in ("kept", "gone"))
    path = Path(_shared._written[gone].removeprefix("file:"))
    assert path.is_dir()
    _shared.drop(gone, gone, None, spark.range(1))
    assert not path.exists()
    assert kept.count() == 3


def test_components_leave_their_last_links_alone(spark):
    folder = Path(_shared.shared_dir(spark).removeprefix("file:")) / "quern"
    _shared.settle(spark.range(1), "any")  # the folder exists
    before = set(folder.iterdir())
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, None), (None, 8), (9, 9)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(chain).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert len(set(folder.iterdir()) - before) == 1
