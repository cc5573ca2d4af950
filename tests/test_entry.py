import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__spark_entry__.__file__).parent


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["conv_id", "doc_text", "pages_detected"]


def test_sql_belongs_to_queries():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_rest_works_without_the_corpus_operators(tmp_path):
    for f in REPO.rglob("*.py"):
        to = f.relative_to(REPO)
        if "llm" not in to.parts and to.name != "corpus_pipeline.py" and ".git" not in to.parts:
            (tmp_path / to).parent.mkdir(parents=True, exist_ok=True)
            shutil.copy(f, tmp_path / to)
    code = "import __spark_entry__ as e; print(*e.queries())"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert "list_newest_first" in out and "pipeline" not in out and not [x for x in out if re.match(r"op\d", x)]


def test_nothing_else_imports_the_corpus_operators():
    for f in (REPO / "quillspark").rglob("*.py"):
        if "llm" not in f.relative_to(REPO).parts:
            assert "quillspark.llm" not in f.read_text(), f
