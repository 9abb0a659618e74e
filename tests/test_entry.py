"""The entry works without the training-data subpackage and without its libraries."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'aggregate_trips' in q, sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q, set(s) <= set(q))"


def counted(folder, code=COUNT):
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def copy(tmp_path, *left_out):
    folder = tmp_path / "copy"
    folder.mkdir()
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", folder)
    shutil.copytree(f"{ROOT}/kerbline", folder / "kerbline", ignore=shutil.ignore_patterns("__pycache__", *left_out))
    return folder


def test_without_the_subpackage(tmp_path):
    total, statements, flagship, dealt, pipeline, named = counted(copy(tmp_path, "llm"))
    assert int(total) > 200 and int(statements) > 190
    assert (flagship, dealt, pipeline, named) == ("True", "0", "False", "True")


def test_without_the_subpackage_and_the_pipeline(tmp_path):
    total, _, flagship, dealt, pipeline, _ = counted(copy(tmp_path, "llm", "corpus_pipeline.py"))
    assert int(total) > 200 and (flagship, dealt, pipeline) == ("True", "0", "False")


def test_without_a_library_of_the_subpackage(tmp_path):
    hidden = "import sys; sys.modules['public_tokenizers'] = None; " + COUNT
    total, _, flagship, dealt, pipeline, _ = counted(copy(tmp_path), hidden)
    assert int(total) > 200 and (flagship, dealt, pipeline) == ("True", "0", "False")


def test_an_error_in_the_library_itself_is_raised(tmp_path):
    folder = copy(tmp_path, "quantiles.py")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "quantiles" in done.stderr
