"""Task functions carry their code: they load and run where the package cannot be imported."""

import os
import subprocess
import sys
import tempfile

import pytest
from pyspark import cloudpickle

from ranklab.llm import extract, importance, simhash, substrings, toxicity, vectors, warc

CASES = {
    "blocks": (extract.blocks, "'<p>a<p>b'", "len(f(x)) == 2"), "fingerprint": (simhash.xxh64, "None", "callable(f)"),
    "extract": (extract._extract, "None", "callable(f)"), "first_pass": (substrings._first_pass, "None", "callable(f)"),
    "features": (toxicity.slice_features, "None", "callable(f)"), "links": (vectors._links, "None", "callable(f)"),
    "records": (warc._records, "None", "callable(f)"), "chunked": (warc.chunked, "b'abc'", "f(x) == b'3\\r\\nabc\\r\\n0\\r\\n\\r\\n'"),
    "grams": (importance.slice_grams, "None", "callable(f)"), "kept": (substrings._kept, "None", "callable(f)"),
}


@pytest.mark.parametrize("name", CASES)
def test_functions_load_without_the_package(name):
    fn, value, holds = CASES[name]
    folder = tempfile.mkdtemp(prefix="ranklab-ship-")
    with open(os.path.join(folder, "f.pkl"), "wb") as out:
        out.write(cloudpickle.dumps(fn))
    code = (f"import sys, pickle; f = pickle.load(open('f.pkl', 'rb')); x = {value}; assert {holds}; "
            "assert not [m for m in sys.modules if m.startswith('ranklab')]")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, check=True, timeout=120)
