"""What the Python functions of the pipeline's stages leave behind in a worker, which stays for later tasks."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from ripplemark.llm.memory import lean

#: Runs one function as a worker does, over batches of 24 MB in all; prints the MB that stay.
WORKER = r"""
import random, re, sys
from pathlib import Path
import numpy as np
import pyarrow as pa
from ripplemark.llm import minhash, suffix

class Frame:  # only remembers the function
    def select(self, *columns): return self
    def groupBy(self, *columns): return self
    def applyInArrow(self, function, schema): return self
    def mapInArrow(self, function, schema):
        self.function = function
        return self

def batches(texts, rows):
    for at in range(0, 2 * len(texts), rows):
        ids = pa.array(range(at, at + rows), pa.int64())
        hashes = pa.array([[] if k % 7 else [own] for k, own in enumerate(anchors * (rows // len(anchors)))], pa.list_(pa.binary()))
        texts_of = pa.array([f"{at} {texts[k % len(texts)]}" for k in range(at, at + rows)])
        yield pa.RecordBatch.from_arrays([ids, texts_of, ids, ids, ids, hashes], ["doc_id", "text", "__sx_taking", "__sx_id", "__sx_twin", "__sx_hashes"])

def held():
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

rng, frame = random.Random(3), Frame()
words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 9))) for _ in range(20_000)]
texts = [" ".join(rng.choices(words, k=400)) for _ in range(4_000)]
anchors = [suffix.anchors(np.frombuffer(t.encode(), np.uint8))[1].tobytes() for t in texts[:40]]
{"signatures": lambda: minhash.signatures(frame, 5), "anchors": lambda: suffix.shared_anchors(frame, "text", 20), "entries": lambda: suffix.entries(frame, "text", [b"g" * 20])}[sys.argv[1]]()
for _ in frame.function(batches(texts[:40], 40)):  # what is loaded and kept for good
    pass
before = held()
for _ in frame.function(batches(texts, 4_000)):
    pass
print(held() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc, and the C library's allocator is the one measured")
@pytest.mark.parametrize("function", ["signatures", "anchors", "entries"])
def test_a_worker_gives_its_memory_back(function):
    """An executor keeps more workers than it has cores; each went on holding what its largest task had needed."""
    run = subprocess.run([sys.executable, "-c", WORKER, function], capture_output=True, text=True, timeout=120, cwd=Path(__file__).parents[2])
    assert run.returncode == 0, run.stderr
    assert float(run.stdout) < 25


def test_lean_changes_no_result():
    """Batches and tables pass as they are, and what a function raises comes out."""

    @lean
    def batches(given):
        yield from (x + 1 for x in given)

    @lean
    def table(given):
        return {**given, "b": 2}

    @lean
    def fails(given):
        yield next(given)
        raise ValueError("text")

    assert list(batches(iter([1, 2]))) == [2, 3] and table({"a": 1}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError, match="text"):
        list(fails(iter([1])))
