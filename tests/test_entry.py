import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_of_sql_exists():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_corpus_operators(tmp_path):
    """With both llm folders taken out, the entry imports and the rest's tests are found and pass; corpus_pipeline.py may be there or not."""
    for gone in (("llm",), ("llm", "corpus_pipeline.py")):
        where = tmp_path / str(len(gone))
        shutil.copytree(ROOT, where, ignore=lambda d, names, gone=gone: [n for n in names if n in (".git", "__pycache__", *gone)])
        env = {**os.environ, "PYTHONPATH": str(where)}
        code = "import __spark_entry__ as e; q = e.queries(); assert 'pre_filter_topk' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=where, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_scalars.py"], cwd=where, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=where, check=True, env=env)
