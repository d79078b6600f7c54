"""Cutting-stock packing: every id once, no padding, few cuts; the program against plain bounds."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

pytest.importorskip("isoframe.llm")

from isoframe.llm import cutting

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(spark, rows, capacity=4096, group=64):
    """Pieces hold every id of every document once, with their crc, and sequences have no gap."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(3)
    got = cutting.pack(df, PATH, 2, capacity, group).collect()
    streams = [(i, np.array([*(tok.encode(t, add_special_tokens=False).ids if t else []), 2], "<u4")) for i, t in rows]
    want, have = {}, {}
    for i, ids in streams:
        want[i] = want.get(i, 0) + len(ids)
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
        assert any(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(ids) == r.doc_tokens for i, ids in streams if i == r.doc_id)
    assert have == want
    for i in {i for i, _ in streams if sum(i == j for j, _ in streams) == 1 and i is not None}:
        spans = sorted((r.start, r.length) for r in got if r.doc_id == i)
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for spans in sequences.values():
        spans.sort()
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        total = sum(n for _, n in spans)
        assert total <= capacity
        padding += 0 if total & (total - 1) == 0 else capacity - total
    return got, padding


def test_pieces_on_odd_texts(spark):
    rows = list(enumerate(["", None, "a", "word " * 9000, "x" * 300, "two words", "two words", "é ﬁ", "  ", "<|endoftext|> a"] + ["tok " * n for n in (1, 2, 3, 60, 61, 62, 4094, 4095, 4096, 2047, 5000)]))
    rows += [(None, "null id"), (None, "null id"), (3, "another text of an id")]
    _, padding = check(spark, rows)
    assert padding == 0
    assert check(spark, [])[0] == []
    assert check(spark, [(1, None)])[1] == 0


def test_one_length_that_most_rows_share(spark):
    rng = random.Random(3)
    rows = list(enumerate(["w " * 40] * 150 + ["v " * rng.randrange(1, 100) for _ in range(120)]))
    got, padding = check(spark, rows, capacity=64, group=8)
    assert padding == 0 and len(got) < 2.2 * len(rows)
    got, padding = check(spark, list(enumerate(["w " * 23] * 100)), capacity=64)  # items of 24: cut once a sequence
    assert padding == 0 and len(got) < 145


def test_columns_and_fills():
    rng = random.Random(5)
    for capacity in (16, 60, 64):
        lengths = sorted(rng.sample(range(1, capacity), 8))
        counts = [rng.randrange(1, 500) for _ in lengths]
        columns = cutting.generate(lengths, counts, capacity)
        used = sum((c * x for c, x in columns), np.zeros(8))
        assert (used <= np.array(counts) + 1e-6).all()
        for c, _ in columns:
            n = int(c @ np.array(lengths))
            assert n == capacity or n & (n - 1) == 0
        values = np.array([rng.random() for _ in lengths])
        best, last = cutting.best_sums(lengths, values, capacity)
        plain = [0.0] + [-np.inf] * capacity
        for s in range(1, capacity + 1):
            plain[s] = max([plain[s - n] + v for n, v in zip(lengths, values, strict=True) if n <= s], default=-np.inf)
        assert np.allclose(best, plain)
        for s in np.flatnonzero(np.isfinite(best)):
            assert np.isclose(cutting.pattern(last, lengths, int(s)) @ values, best[s])
        rows, stream, sequences, tokens = cutting.plan_group(lengths, counts, capacity)
        held = {n: 0 for n in lengths}
        for n, low, high, *_ in rows + stream:
            assert low == held[n]
            held[n] = high
        assert held == dict(zip(lengths, counts, strict=True))
        assert tokens == sum(n * (high - low) for n, low, high, _ in stream)
    assert cutting.exact_fill([3, 5], [1, 1], 8) == [1, 1] and cutting.exact_fill([3, 5], [1, 1], 9) is None
    assert cutting.exact_fill([2], [100], 8) == [4]
    assert cutting.stream_starts(4096 + 1024 + 5) == (4096, [4096, 5120, 5124]) and cutting.stream_starts(0) == (0, [])


def test_few_documents_are_cut(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got, padding = check(spark, rows)
    n_whole = sum(-(-r.doc_tokens // 4096) for r in {r.doc_id: r for r in got}.values())
    assert padding == 0 and len(got) - n_whole < 40
