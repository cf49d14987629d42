"""The entry without a library that only the training-data operators need."""

import os
import subprocess
import sys

from tests.conftest import ROOT


def test_a_missing_library_takes_only_its_operators_away():
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op7') for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, "PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, pipeline, op7 = out.stdout.split()[-3:]
    assert int(n) > 200 and pipeline == op7 == "False"
