"""Phrase collocations against plain counting, on odd texts and split blocks."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

pytest.importorskip("isoframe.llm")

from isoframe.llm import collocation


def plain(rows, support, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3, 4):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, of in counts.items():
        often = {p: n for p, n in of.items() if n >= support}
        found = []
        for p, a in often.items():
            if len(p) < 2 or any(len(q) > len(p) and 100 * n >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, n in often.items()):
                continue
            score, k = min((2_000_000 * a // (of[p[:k]] + of[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, lo, r, totals[lang], -s) for i, (s, a, p, lo, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_phrases_equal_plain_counts(spark, monkeypatch, block):
    monkeypatch.setattr(collocation, "BLOCK_BYTES", block)
    monkeypatch.setattr(collocation, "SLICE_ROWS", 100 if block == 300 else 5_000_000)
    rng = random.Random(1)
    words = ["The", "of", "Ähre", "日本", "a b", "x y", "to", "be", "or", "not"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "?!", " \x0d "]
    texts = ["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    texts += ["to be or not to be"] * 9 + ["na " * 40, None, "", " ,. ", "W" * 700, "to be or not " * 60]
    rows = [(rng.choice(["en", "de", None, "und", ""]), t) for t in texts]
    df = spark.createDataFrame([(*r, "n", 5) for r in rows], "lang string, text string, word string, n int").repartition(3)
    got = collocation.collocations(df, support=4, top=25)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == plain(rows, 4, 25)


def test_phrases_of_nothing(spark):
    assert collocation.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocation.collocations(spark.createDataFrame([("en", "one two"), (None, None)], "lang string, text string")).collect() == []


def test_scores_pass_64_bits(spark):
    """Counts of 10^13 times two million."""
    tables = [
        spark.createDataFrame([(1, "en", "a", 10**13 + 7), (2, "en", "b", 10**13 + 1)], "id long, lang string, word string, f long"),
        spark.createDataFrame([(3, 1, 2, 10**13)], "id long, a long, b long, f long"),
    ]
    row = collocation.ranked(collocation.candidates(tables), spark.createDataFrame([("en", 9)], "lang string, n long"), 10).first()
    assert row.score == 2_000_000 * 10**13 // (2 * 10**13 + 8)
