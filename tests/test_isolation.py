"""The library without its optional parts: no corpus operators, no pipeline."""

import os
import shutil
import subprocess
import sys
import tempfile

from conftest import ROOT

CODE = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()), any(q.startswith('op') and q[2].isdigit() for q in E.queries()))"


def test_without_the_corpus_operators():
    d = os.path.join(tempfile.mkdtemp(prefix="tf-alone-"), "repo")
    gone = lambda folder, names: {n for n in names if n in ("llm", ".git", "corpus_pipeline.py", "__pycache__")}
    shutil.copytree(ROOT, d, ignore=gone)
    out = subprocess.run([sys.executable, "-c", CODE], cwd=d, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, oracles, corpus = out.stdout.split()
    assert int(n) == int(oracles) >= 83 and corpus == "False"
    # nothing outside the package imports it
    for folder, _, files in os.walk(os.path.join(d, "tallyframe")):
        for f in files:
            if f.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, f)).read(), f
