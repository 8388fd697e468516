import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code, cwd=ROOT):
    return subprocess.run([sys.executable, "-c", code], cwd=cwd, env={**os.environ, "PYTHONPATH": cwd}, capture_output=True, text=True, timeout=120)


def test_registry_is_read_without_a_session():
    done = run("import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))")
    assert done.returncode == 0, done.stderr
    n, subset = done.stdout.split()
    assert int(n) > 180
    assert subset == "True"


def test_core_stands_without_the_corpus_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    done = run("import __spark_entry__ as e; print([k for k in e.queries() if k == 'pipeline' or k.startswith('op1_')])", str(tmp_path / "r"))
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "[]"
    for folder, _, names in os.walk(tmp_path / "r" / "lumenarc"):
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert not re.search(r"lumenarc\.llm|corpus_pipeline", f.read()), n


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["rank", "paper_id", "chunk_id", "score", "title", "item_type", "year"]
    assert df.count() > 0
