import pytest

from compare import matches_sql
from symweave.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, spark, duck, sf_dir):
    matches_sql(spark, duck, sf_dir, QUERIES[name], ORACLES[name])


def test_every_query_is_callable_and_named(spark, sf_dir):
    assert set(ORACLES) <= set(QUERIES)
    assert QUERIES["bfs_order"](spark, sf_dir).columns == ["node_id", "position"]


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_stands_without_the_training_operators(tmp_path):
    """The entry file and the other queries import where the subpackage, its tests and the pipeline are deleted, or only some of them."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for kept in ((), ("corpus_pipeline.py",)):
        copy = tmp_path / f"copy{len(kept)}"
        copy.mkdir()
        for name in ("__spark_entry__.py", *kept):
            if os.path.exists(f"{root}/{name}"):
                shutil.copy(f"{root}/{name}", copy / name)
        shutil.copytree(f"{root}/symweave", copy / "symweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q), list(q); assert len(q) > 60 and set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy), "PYTHONDONTWRITEBYTECODE": "1"})
