"""Python workers give freed memory back when a task ends."""

import subprocess
import sys
from pathlib import Path

import pytest

SCRIPT = """
import re
import pyarrow as pa
from pulsegrid.llm.common import slices

def resident():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

batch = pa.RecordBatch.from_pydict({"x": list(range(600))})
list(slices(iter([batch])))
before = resident()
blocks = [bytes(2000) for _ in range(100_000)]
held, blocks = blocks[-1], None  # the last block keeps the heap from shrinking by itself
assert [b.num_rows for b in slices(iter([batch]))] == [256, 256, 88]
print(resident() - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="memory is read from /proc")
def test_freed_memory_goes_back():
    grown = float(subprocess.run([sys.executable, "-c", SCRIPT], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True).stdout)
    assert grown < 50  # MB, of 200
