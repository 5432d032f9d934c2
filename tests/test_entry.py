import subprocess
import sys

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 7, 8)} | {"p6_ids"} <= set(entry.queries()) or entry.llm is None


def test_the_rest_stands_without_the_subpackage():
    code = "import sys, importlib.abc\nclass F(importlib.abc.MetaPathFinder):\n  def find_spec(self, n, p, t=None):\n    if n.startswith('strataline.llm'): raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, F())\nimport __spark_entry__ as e\nassert e.llm is None and e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.Path(entry.__file__).parent)
