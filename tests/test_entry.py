import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_every_query_with_sql_is_registered():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 60


def test_the_core_imports_without_the_optional_package(tmp_path):
    code = "import sys; sys.modules['tagloom.llm'] = None\nimport __spark_entry__ as e; print(len(e.queries()))"
    r = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert r.returncode == 0 and int(r.stdout.split()[-1]) > 50, r.stderr


def test_nothing_else_imports_the_optional_package():
    for folder, _, files in os.walk(f"{ROOT}/tagloom"):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for f in files:
            if f.endswith(".py"):
                assert "tagloom.llm" not in open(f"{folder}/{f}", encoding="utf-8").read(), f


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    import __spark_entry__ as e

    r = e.entry(spark).collect()
    assert len(r) == 1 and 0 <= r[0].f1 <= 1
