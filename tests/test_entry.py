"""The entry module without the text part, or without a library it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent

CODE = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
assert "fig3a_distribution" in entry.queries() and "fig3a_distribution" in entry.oracle_sql()
assert "pipeline" not in entry.queries(), sorted(entry.queries())
"""


@pytest.mark.parametrize("name, warned", [("cohortspark.llm", False), ("corpus_pipeline", False),
                                          ("ahocorasick", True)])
def test_entry_without_a_module(name, warned):
    if not (ROOT / "cohortspark" / "llm").exists() and warned:
        pytest.skip("the text part is not installed")
    done = subprocess.run([sys.executable, "-c", CODE.format(name=name)], cwd=ROOT,
                          capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert ("no text queries" in done.stderr) == warned
