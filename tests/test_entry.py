import importlib.util
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_contract(spark, sf):
    module = _entry()
    assert set(module.oracle_sql()) <= set(module.queries())
    assert module.entry(spark).count() == 10


def test_sources_are_clean():
    """No cross join, local checkpoint or unbounded window in the package."""
    banned = ("crossJoin(", "localCheckpoint", ".toPandas(", "@F.udf", "rdd.")
    for path in (ROOT / "foldloom").rglob("*.py"):
        text = path.read_text()
        for word in banned:
            assert word not in text, f"{word} in {path}"
