"""The entry points load with and without the optional part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

REPORT = """
import sys
sys.path.insert(0, {root!r})
{before}
import __spark_entry__ as entry
names = entry.queries()
print(len([n for n in names if not n.startswith("op") and n != "pipeline"]), len(entry.oracle_sql()))
print([n for n in names if n.startswith("op") or n == "pipeline"])
"""

HIDE = """
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == "public_tokenizers":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hidden())
"""


def report(root, before=""):
    code = REPORT.format(root=root, before=before)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", code], capture_output=True, text=True, cwd=root, env=env
    )
    assert done.returncode == 0, done.stderr
    counts, optional = done.stdout.strip().split("\n")
    return [int(n) for n in counts.split()], eval(optional)


def copied(tmp_path, left_out):
    target = tmp_path / "copy"
    skip = shutil.ignore_patterns(".git", "__pycache__", "*.pyc")

    def ignore(folder, names):
        inside = os.path.relpath(folder, ROOT)
        gone = {n for n in names if os.path.normpath(os.path.join(inside, n)) in left_out}
        return gone | skip(folder, names)

    shutil.copytree(ROOT, target, ignore=ignore)
    return str(target)


def test_core_queries_without_the_optional_folders(tmp_path):
    root = copied(tmp_path, {"tableloom/llm", "tests/llm", "corpus_pipeline.py"})
    (core, oracles), optional = report(root)
    assert core >= 59 and oracles == core and optional == []


def test_core_queries_when_only_the_pipeline_is_left(tmp_path):
    root = copied(tmp_path, {"tableloom/llm", "tests/llm"})
    (core, oracles), optional = report(root)
    assert core >= 59 and oracles == core and optional == []


def test_core_queries_when_a_needed_module_is_hidden():
    (core, _), _ = report(ROOT, HIDE)
    assert core >= 59
