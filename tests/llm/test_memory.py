"""Memory of Python workers that run several stages one after another."""

import subprocess
import sys

import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402

from isoframe.llm import packing, scratch  # noqa: E402

_FREED = """
import re
import numpy as np
from isoframe.llm.tokenize import forget

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

np.ones(30 << 20, np.uint8)  # from now on arrays of this size come from C's heap, not from pages of their own
arrays, pins = [], []
for _ in range(4):
    arrays.append(np.ones(20 << 20, np.uint8))
    pins.append(np.ones(2000, np.uint8))
full = held()
arrays.clear()
forget()
print(full - held())
"""


def test_forget_gives_freed_memory_back():
    out = subprocess.run([sys.executable, "-c", _FREED], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert float(out.stdout) > 70  # 60 come back without it, 80 with it


def test_stage_bounds_arrow_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = [r.n for r in scratch.stage(spark.range(3000).coalesce(1).mapInArrow(sizes, "n long"), "sizes", batch_rows=500).collect()]
    assert sum(rows) == 3000 and max(rows) <= 500
    assert spark.conf.get(key) == before


def test_packing_with_a_small_memo_gives_the_same_pieces(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150).localCheckpoint()
    path = public_tokenizers.path("byte_bpe_50k.json")
    usual, small = (sorted(map(tuple, packing.pack(docs, path, 2, keep_order=True, **kw).collect())) for kw in ({}, {"memo_units": 5}))
    assert usual and usual == small
