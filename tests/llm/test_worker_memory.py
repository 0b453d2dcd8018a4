"""What a Python worker holds: no threads of the tokenizer's, and no Arrow memory that no batch uses."""

import os
import subprocess
import sys

import pyarrow as pa

from folio.llm import common

CODE = """
import os
import pyarrow as pa
import public_tokenizers
from folio.llm.packing import WordCoder
coder = WordCoder(public_tokenizers.path("word_bpe_49k.json"))
before = len(os.listdir("/proc/self/task"))
coder.encode(pa.array([" ".join(f"w{i}o{i * 7}" for i in range(20_000)) + " plain words " * 5_000]))
print(len(os.listdir("/proc/self/task")) - before)
"""


def test_word_coder_starts_no_threads():
    env = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")}
    env["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), env.get("PYTHONPATH", "")])
    said = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, check=True).stdout
    assert int(said) <= 1  # with threads it is one for each core


def test_released_passes_every_batch():
    batches = [pa.RecordBatch.from_arrays([pa.array([k] * k)], names=["k"]) for k in range(4)]
    assert [b.num_rows for b in common.released(lambda given: (b for b in given))(iter(batches))] == [0, 1, 2, 3]
