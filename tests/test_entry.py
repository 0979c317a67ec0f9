"""The driver contract with and without the optional libraries."""

import subprocess
import sys

from tests.conftest import ROOT

CODE = """
import sys
sys.path.insert(0, {root!r})
for name in {blocked!r}:
    sys.modules[name] = None
import __spark_entry__ as e
q = e.queries()
assert set(e.oracle_sql()) <= set(q)
print(len(q), any(n.startswith("op") and n[2].isdigit() for n in q), "pipeline" in q)
"""


def registered(*blocked: str) -> list[str]:
    out = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, blocked=blocked)], capture_output=True, text=True, check=True)
    return out.stdout.split()


def test_core_queries_without_optional_libraries():
    for blocked in (("ahocorasick",), ("public_tokenizers",), ("quarry.llm",), ("corpus_pipeline",)):
        n, op, pipeline = registered(*blocked)
        assert int(n) >= 71 and op == "False" and pipeline == "False"
