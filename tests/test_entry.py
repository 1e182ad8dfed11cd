import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
BLOCKED = """
import sys
class Blocker:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[: {depth}] == {parts}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Blocker())
import __spark_entry__ as e
names, sql = e.queries(), e.oracle_sql()
assert len(names) > 100 and set(sql) <= set(names)
assert not [n for n in names if n.startswith("op") or n == "pipeline"], names
"""


@pytest.mark.parametrize("module", ["docwarden.llm", "xxhash"])
def test_core_queries_stand_alone(module):
    parts = module.split(".")
    code = BLOCKED.format(depth=len(parts), parts=parts)
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
