"""Scores of the trained models beside plain recomputations, text by text and window by window."""

import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard

pytest.importorskip("public_tokenizers")

from isoframe.llm import arrow, folds, language, quality, toxicity  # noqa: E402

ODD = ["", None, "a", " \n", "Éa b" * 40, "x" * 3000, "1 2 3 # $", "word " * 700, "un deux trois. quatre\n\ncinq", "emoji 😀 text"]


def one_hash(raw: bytes) -> int:
    data = np.frombuffer(raw, np.uint8)
    return int(arrow.span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def lower(raw: bytes) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in raw)


def compressor(data, params):
    d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").limit(120)
    odd = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(ODD)], "doc_id long, text string, lang string")
    return docs.unionByName(odd)


def test_toxicity_scores(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic, ordinary, weights = model = toxicity.train(docs, labels.where(~folds.is_held_out()))
    assert toxic and ordinary and toxic != ordinary
    z = zstandard
    params = z.ZstdCompressionParameters(window_log=19, hash_log=17, chain_log=17, search_log=3, min_match=6, target_length=16, strategy=z.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
    a, b = compressor(toxic, params), compressor(ordinary, params)
    some = rows(spark, sf_dir)
    got = {r.doc_id: r.score for r in toxicity.score(some.select("doc_id", "text"), model).collect()}
    for r in some.collect():
        words = [lower(w) for w in re.findall(rb"[A-Za-z\x80-\xff]+", (r.text or "").encode())]
        codes = [b"".join((((one_hash(w[:k]) + (len(w) < k)) % 2**64) >> 32).to_bytes(4, "little") for k in (3, 4, 5)) + (one_hash(w) >> 32).to_bytes(4, "little") for w in words]
        gains = [max(0, len(b.compress(w)) - len(a.compress(w))) for w in (b"".join(codes[i : i + 64]) for i in range(0, len(codes), 64))]
        strong = [g for g in gains if g >= 4]
        x = [max(gains), np.log1p(sum(strong)), np.log1p(len(strong)) - 0.25 * np.log1p(len(gains))] if gains else [0, 0, 0]
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-(np.dot(x, weights[:-1]) + weights[-1]))), abs=1e-9)


def test_toxic_dictionary_holds_toxic_text():
    rng = np.random.default_rng(1)
    common = [a + b + c for a in "bdfg" for b in "aeiou" for c in ("lan", "mor", "nit", "pes", "run")] * 3
    text = lambda extra: " ".join(rng.choice(common + extra, 60))
    toxic, ordinary = [text(["horrid"] * 20) for _ in range(60)], [text(["lovely"] * 20) for _ in range(60)]
    first, second = toxicity.train_dictionaries(toxic, ordinary)
    code = lambda w: toxicity.word_codes(*arrow.flat(pa.array([w])))[0].tobytes()
    assert code("horrid") in first and code("horrid") not in second and code("lovely")[:8] in second


def test_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs.where(~folds.is_held_out()))
    z = zstandard
    params = z.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=2, min_match=4, strategy=z.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    each = {k: compressor(v, params) for k, v in model.items()}
    some = rows(spark, sf_dir)
    got = {r.doc_id: r for r in language.classify(some.select("doc_id", "text"), model).collect()}
    for r in some.collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        raw = r.text.lower().encode()
        sizes = {k: sum(len(c.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024)) for k, c in each.items()}
        best = min(sizes, key=lambda k: (sizes[k], list(sizes).index(k)))
        assert got[r.doc_id].lang_pred == best
        assert got[r.doc_id].score == pytest.approx(1 / sum(np.exp(-min(50, (n - sizes[best]) / 4)) for n in sizes.values()))


def test_many_languages_and_repeats(spark):
    rows = [(i % 3000, f"text of language {i % 1500} " * 3, f"l{i % 1500}") for i in range(3000)]
    docs = spark.createDataFrame(rows + rows[:10] + [(1, None, "l1"), (2, "no label", None)], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(model) == 1500 and sum(map(len, model.values())) <= language.TOTAL_BYTES
    assert language.train(docs.limit(0)) == {}


def test_quality_scores():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(3 << quality.BUCKETS_LOG2) + 1)
    texts = [*ODD, "the end of the end", "A b\tc"]
    got = quality._scores(quality.Counted(pa.array(texts, pa.string())), weights)
    shift = 64 - quality.BUCKETS_LOG2
    for t, score in zip(texts, got, strict=True):
        raw = (t or "").encode()
        words = np.array([one_hash(w) for w in re.findall(rb"[^\x20\x09-\x0d]+", raw)], np.uint64)
        groups = [
            [int(arrow.mix(w.reshape(1) + np.uint64(1))[0]) >> shift for w in words],
            [int(arrow.shingle_hashes(words[i : i + 2], 2)[0]) >> shift for i in range(len(words) - 1)],
            [((((raw[i] << 16) | (raw[i + 1] << 8) | raw[i + 2]) * 2654435761) % 2**32) >> (32 - quality.BUCKETS_LOG2) for i in range(len(raw) - 2)],
        ]
        want = weights[-1] + sum(np.mean([weights[(g << quality.BUCKETS_LOG2) + b] for b in buckets]) for g, buckets in enumerate(groups) if buckets)
        assert score == pytest.approx(want)


def test_words_that_collide_modulo_powers_of_two(spark):
    """Thue-Morse words: a polynomial hash modulo 2^64 takes them for the same, whatever its base."""
    from isoframe.llm import jaccard, quality

    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((a + b + a).encode(), np.uint8)
    n = len(a)
    h = arrow.span_hashes(data, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert h[0] == h[2] != h[1]
    for size in (*range(1, 26), 511, 512, 513):  # at any place, with any end
        assert arrow.span_hashes(data, np.array([3]), np.array([3 + size])) == arrow.span_hashes(np.roll(data, -2), np.array([1]), np.array([1 + size]))
    assert quality.Counted(pa.array([a + "\n" + b, a + "\n" + a])).statistics()["n_dup_lines"].tolist() == [0, 1]
    rows = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_join(rows).collect()) == [(1, 1), (2, 2), (3, 1)]
