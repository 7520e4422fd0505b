import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_have_sql_of_their_own():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "od_grid" in e.queries()


def test_entry_runs(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["origin", "dest", "period", "flow", "share"] and out.count() > 0


def test_without_the_llm_folder(tmp_path):
    """The rest imports and has its queries when the subpackage and the pipeline are gone."""
    import shutil

    shutil.copytree(f"{ROOT}/almanac", f"{tmp_path}/almanac", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [k for k in e.queries() if k.startswith('op')])"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert said.returncode == 0 and said.stdout.split()[-1] == "[]" and int(said.stdout.split()[0]) > 30
