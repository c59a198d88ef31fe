"""Functions that run in workers travel by value: workers need not have the package."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle

import scanloom
from scanloom.functions import jsregex
from scanloom.operators import textdiff
from scanloom.sources import documentsink, store, tree

cloudpickle.register_pickle_by_value(scanloom)


@pytest.mark.parametrize(
    ("function", "call"),
    [
        (jsregex.java_regex, "f(r'a\\b', 'i')"),
        (jsregex.java_regex, "f(r'[\\p{L}--k]', 'vi')"),
        (textdiff.hunks, "f(['a'], ['b'])"),
        (store._list_folders, "f([])"),
        (documentsink.DocumentWriter, "f('/nowhere', ['project_id', 'text'])"),
        (tree._read_one, "f('/', 'none', 1, 'file', None)"),
        (tree.TreeReader, "list(f({'roots': '/nowhere'}).read(f({'roots': '/nowhere'}).partitions()[0]))"),
    ],
)
def test_by_value(tmp_path, function, call):
    (tmp_path / "f").write_bytes(cloudpickle.dumps(function))
    code = f"import pickle; f = pickle.load(open('f', 'rb')); print({call})"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
