"""The driver's entry point with and without the training-data operators."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

HIDDEN = """
import sys

class Hide:
    def find_spec(self, name, path=None, target=None):
        if name.startswith({hidden!r}):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Hide())
sys.path.insert(0, {root!r})
import __spark_entry__ as entry

found, sql = entry.queries(), entry.oracle_sql()
assert entry.FLAGSHIP in found and set(sql) <= set(found)
print(len(found), sum(n.startswith("op") for n in found), "pipeline" in found)
"""


def loaded(*hidden):
    code = HIDDEN.format(hidden=hidden, root=ROOT)
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd="/")


@pytest.mark.parametrize("hidden", [("bourselake.llm",), ("bourselake.llm", "corpus_pipeline")])
def test_core_queries_without_the_optional_parts(hidden):
    done = loaded(*hidden)
    assert done.returncode == 0, done.stderr
    total, optional, pipeline = done.stdout.split()
    assert int(total) > 250 and (optional, pipeline) == ("0", "False")


def test_a_fault_inside_them_is_an_error():
    done = loaded("bourselake.llm.common")
    assert done.returncode != 0 and "bourselake.llm.common" in done.stderr
