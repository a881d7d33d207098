"""The rest works with the training-data folders deleted."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import __spark_entry__ as e
names = e.queries()
assert not [n for n in names if n == "pipeline" or n.startswith("op1_")] and "v9_label_topk" in names
assert set(e.oracle_sql()) <= set(names)
if RUN:
    from quillgraph.session import session

    spark = session("local[2]", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"})
    for name in ("v9_label_topk", "j5_merge_into", "h25_batch_closure", "b11_upsert_versions", "o2_ego_nodes", "r13_structured_output"):
        assert not names[name](spark, "/root/testdata/sf0.001").isEmpty(), name
"""


def test_entry_without_the_llm_folders(tmp_path):
    to = tmp_path / "copy"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    for kept in (True, False):  # with and without the pipeline's file
        if not kept:
            os.remove(to / "corpus_pipeline.py")
        subprocess.run([sys.executable, "-c", f"RUN = {not kept}\n{CODE}"], cwd=to, env={**os.environ, "PYTHONPATH": str(to)}, check=True)
