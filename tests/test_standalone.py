"""The repository without its optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_points_import_without_the_training_data_part(tmp_path):
    """With both llm folders gone, and with the pipeline's file there or not."""
    for left_out in (("llm",), ("llm", "corpus_pipeline.py")):
        copy = tmp_path / str(len(left_out))
        for name in ("votecount", "__spark_entry__.py", "corpus_pipeline.py"):
            source = ROOT / name
            if name in left_out or not source.exists():
                continue
            if source.is_dir():
                shutil.copytree(source, copy / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
            else:
                copy.mkdir(exist_ok=True)
                shutil.copy(source, copy / name)
        told = "import __spark_entry__ as e; print(len(e.queries()), sorted(set(e.queries()) ^ set(e.oracle_sql())))"
        out = subprocess.run([sys.executable, "-c", told], cwd=copy, capture_output=True, text=True)
        assert out.returncode == 0, out.stderr
        count, without_sql = out.stdout.split(" ", 1)
        assert int(count) > 100 and without_sql.strip() == "[]"
