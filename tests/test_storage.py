from pathlib import Path
from types import SimpleNamespace

import pytest

from tessella.storage import clear_shared, materialize, shared_dir, small


def test_tables_live_in_the_named_folder_until_cleared(spark):
    df = materialize(spark.range(5), "numbers")
    folder = Path(shared_dir(spark).removeprefix("file:")) / "tessella"
    assert df.count() == 5 and list(folder.rglob("*.parquet"))
    assert materialize(spark.range(0), "none").columns == ["id"]
    clear_shared(spark)
    assert not list(folder.rglob("*.parquet"))


def test_broadcast_only_up_to_a_count(spark):
    plan = lambda n: spark.range(50).join(small(spark.range(10), n), "id")._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint (strategy=broadcast)" in plan(10) and "ResolvedHint" not in plan(9)


@pytest.mark.parametrize("master, fine", [("local", True), ("local[*]", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("yarn", False), ("spark://host:7077", False)])
def test_only_one_process_gets_a_folder_of_its_own(master, fine):
    held = {}
    conf = SimpleNamespace(get=lambda key, default=None: held.get(key, default), set=held.__setitem__)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    if fine:
        assert shared_dir(session).startswith("file:///") and shared_dir(session) == held["spark.checkpoint.dir"]
    else:
        with pytest.raises(ValueError):
            shared_dir(session)
        assert not held
