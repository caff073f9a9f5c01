import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_imports_without_llm():
    """Nothing but the entry may know the training-data subpackage."""
    code = "import sys; sys.modules['strataspark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'type_summary' in e.queries(); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    for path in (ROOT / "strataspark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "strataspark.llm" not in path.read_text()
