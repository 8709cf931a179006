import os
import shutil
import subprocess
import sys

import __spark_entry__ as driver


def test_contract(spark):
    rows = driver.entry(spark)
    assert rows.columns == ["doc_id", "VisitDateTime_Range"]
    times = [r.VisitDateTime_Range for r in rows.collect()]
    assert times == sorted(times) and len(times) <= 50
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_it_stands_without_the_llm_folders(tmp_path):
    """The entry point imports, and lists all other queries, in a copy of the repository without them."""
    here = os.path.dirname(driver.__file__)
    for name in ("__spark_entry__.py", "folioscan"):
        source, target = os.path.join(here, name), tmp_path / name
        if os.path.isdir(source):
            shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, target)
    code = "import __spark_entry__ as d; from folioscan.plans import QUERIES; assert set(d.queries()) == set(d.oracle_sql()) == set(QUERIES)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
