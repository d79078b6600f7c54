"""Token alignment against a plain walk over all pairs of tokens."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest

pytest.importorskip("isoframe.llm")

from isoframe.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts: list[str | None]) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, n_best, count_sum, sha of each text, by whole texts and byte ranges."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in keep]
    byte_of = {chr(x): x for x in keep} | {chr(256 + i): x for i, x in enumerate(others)}
    docs = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        ia, ib = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        ba = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ib)]
        if not text or b"".join(ba) != whole or b"".join(bb) != whole:
            docs.append(([], [], [], ""))
            continue
        spans = []
        for parts in (ba, bb):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        links = [(ia[i], ib[j]) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if max(s, t) < min(e, f)]
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for c in common:
            groups.append(",".join(str(i) for i, (_, e) in zip(ia, spans[0]) if low < e <= c) + "|" + ",".join(str(i) for i, (_, e) in zip(ib, spans[1]) if low < e <= c))
            low = c
        docs.append((ia, ib, links, ";".join(groups)))
    counts = Counter(p for _, _, links, _ in docs for p in set(links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (len(ia), len(ib), len(g.split(";")) if g else 0, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for ia, ib, links, g in docs
    ]


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b  ", "a \n b", "x\ty", "the cat's hat, didn't 12345 é ﬁ ½", "<|endoftext|> is plain", "a<|endoftext|>b </s> <s> <unk>", "▁ mark", "a▁b",
    "日本語 の テキスト", "naïve “quotes” — dash…", "😀 emoji👩‍👩‍👧 joined", " nbsp   x", "　wide 　x", "z̀ ̀combining", "a\x00b \x1c c", "<0x41> plain", "word " * 300 + "end", "y" * 3000, "the the the", "the the the",
]


def test_alignment_equals_pairs_of_byte_ranges(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 2000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(12).collect()
    texts = ODD + [r["text"] for r in docs]
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pairs int").repartition(3)
    out, pairs = alignment.align(df, A, B)
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in out.collect()}
    want = plain(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i])
    assert pairs.where("is_best").select("a_id").distinct().count() == pairs.select("a_id").distinct().count()


def test_alignment_of_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, A, B)[0].collect() == []
    rows = alignment.align(spark.createDataFrame([(None, "one"), (None, "one"), (3, None)], "doc_id long, text string"), A, B)[0].collect()
    assert sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in rows) == [(0, 1, 2), (0, 1, 2), (3, 0, 0)]
