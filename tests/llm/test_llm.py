"""Dealt operators on small cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from isoframe.llm import ann, jaccard, language, license_scan, mixing, packing, quality, scratch, token_store, tokenize, toxicity, url_filter  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD_BPE, BYTE_BPE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
ODD = ["", None, "a", " ", "\n\n", "x" * 5000, "a   b\t c \n d", "é́ ñ Ü", "<|endoftext|> hi", "tail ", " lead", "1 2 3 ok 's don't 'RE", "word " * 3000, "　wide space", "emoji 😀 text"]


def documents(spark, texts, **extra):
    rows = [(i, t, "en", f"src{i % 3}", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_unit_encoder_equals_the_tokenizer(path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    rng = random.Random(1)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "  ", "\n", " \n", "\t", ".", ",", "'s", "é", "Ü", "ß", "1", "42", "#", "—", "word", "Word", " ", "\x1c", "ﬁ", "İ", "ǅ"]
    texts = ODD + ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 40))) for _ in range(5000)]
    enc = tokenize.UnitEncoder(path, memo_units=50)
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, enc.dtype).tolist() == (plain.encode(text, add_special_tokens=False).ids if text else []), repr(text)


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_unit_encoder_equals_the_tokenizer_on_plain_latin_texts(path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    rng = random.Random(3)
    marks = [" ", " ", " ", "  ", "\n", ".\n", ". ", ", ", ".", ",", ".,", "...", "'", "'s", "'S", "'.", "don't.", "Ànd", "ÿß", "É", "word", "WORD", "1", "42", "3.14", "-", "#", "(a)", "x" * 70]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 40))) for _ in range(4000)] + [None, "", "\n", " ", ".", "٣ word", "a\tb."]
    enc = tokenize.UnitEncoder(path, memo_units=50)
    for _ in range(2):  # the second time with what is remembered
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(ids, enc.dtype).tolist() == (plain.encode(text, add_special_tokens=False).ids if text else []), repr(text)


def test_word_encoder_computes_each_word_once():
    rng = random.Random(4)
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    text = lambda: "".join(rng.choice((str.title, str.upper, str.lower))(rng.choice(words)) + rng.choice([" ", "\n", ". ", ", ", ".\n", ",\n"]) for _ in range(300))
    enc = tokenize.UnitEncoder(WORD_BPE)
    enc.encode([text() for _ in range(100)])
    assert len({*enc.memo, *enc.words}) <= len(words) + 2  # words, point and comma, not each case and line end with its neighbours


def test_byte_level_encoder_looks_each_part_of_plain_latin_texts_up_once():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(5)
    words = [a + b + c for a in "bdfgkÉ" for b in "aeiouü" for c in "lmnrs"]
    ends = [" ", " ", "  ", "\n", "\n\n", " \n ", ". ", ", ", ".\n", "'s ", "'llx", "'re'd", " 't", "''m", "'S", "7", "42 ", "#"]
    texts = ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    enc = tokenize.UnitEncoder(BYTE_BPE)
    computed, compute = collections.Counter(), enc._encode_word
    enc._encode_word = lambda word: computed.update([word]) or compute(word)
    for _ in range(2):
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(ids, enc.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert computed == dict.fromkeys((w for t in texts for w in enc.split(t)), 1)
    assert not enc.memo  # no words with the line ends and marks between them


def test_parts_and_units_share_one_room():
    enc = tokenize.UnitEncoder(BYTE_BPE, memo_units=40)
    for text in (" ".join(f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"), " ".join(f"—{i}" for i in range(100)), " ".join(f"z{a}" for a in "abcdefgh")):
        want = enc.whole(text)
        assert enc.encode([text]) == [want]
        assert len(enc.memo) + len(enc.words) <= 60


def test_token_store_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    shared = prose(rng, 900)
    texts = ODD + [shared, shared, shared + " more", "head " + shared, prose(rng, 2000)]
    docs = documents(spark, texts).unionByName(documents(spark, texts).where("doc_id = 3"))
    store = token_store.write_store(docs, WORD_BPE, 2, scratch.new_path(spark, "t"))
    tok = Tokenizer.from_file(WORD_BPE)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.verified) for r in token_store.read_back(store).collect())
    at, want = 0, []
    for i in sorted([*range(len(texts)), 3]):
        ids = np.array([*(tok.encode(texts[i], add_special_tokens=False).ids if texts[i] else []), 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes()), True))
        at += len(ids)
    assert got == want
    for r in token_store.restore(store).collect():
        ids = np.frombuffer(bytes(r.ids), "<u2").astype("<u4")
        assert (r.start, len(ids), zlib.crc32(ids.tobytes())) in {(w[1], w[2], w[3]) for w in want}
        assert token_store.merkle_root([bytes(x) for x in r.digests]) == bytes(r.root)
    stored = store.chunks.agg({"n_ids": "sum"}).first()[0]
    assert stored < at  # copies share chunks
    assert store.chunks.count() == store.chunks.select("digest").distinct().count()
    assert store.manifest.agg({"n_tokens": "sum"}).first()[0] == at


def test_token_store_shows_lost_and_changed_chunks(spark):
    rng = random.Random(20)
    shared = prose(rng, 700)
    texts = [shared, shared, prose(rng, 500), prose(rng, 500), None]
    store = token_store.write_store(documents(spark, texts), WORD_BPE, 2, scratch.new_path(spark, "t"), docs_per_part=2)
    fine = {r.doc_id: r for r in token_store.read_back(store).collect()}
    assert len(fine) == 5 and all(r.verified for r in fine.values()) and store.manifest.count() > 1
    by_doc = {r.doc_id: [bytes(d) for d in r.digests] for r in store.recipes.collect()}
    lost, changed = by_doc[2][0], by_doc[3][-1]
    assert lost not in by_doc[3]
    chunks = [(bytes(r.digest), r.n_ids, bytes(r.ids)) for r in store.chunks.collect()]
    chunks = [(d, n, b"\x01\x00" * n if d == changed else ids) for d, n, ids in chunks if d != lost]
    damaged = token_store.TokenStore(spark.createDataFrame(chunks, store.chunks.schema), store.recipes, store.manifest, store.seal, 2)
    got = {r.doc_id: r for r in token_store.read_back(damaged).collect()}
    assert {i: r.verified for i, r in got.items()} == {0: True, 1: True, 2: False, 3: False, 4: True}
    assert got[2].ids_crc32 is None and got[3].ids_crc32 is None and got[2].n_tokens == fine[2].n_tokens
    # a recipe under another root of its own is against its block; a manifest without a block is against the seal
    first = store.recipes.orderBy("start").first().part
    forged = spark.createDataFrame([(r.part, r.doc_id, r.start, r.n_tokens, b"x" if r.doc_id == 0 else bytes(r.root), list(r.digests)) for r in store.recipes.collect()], store.recipes.schema)
    got = {r.doc_id: r.verified for r in token_store.read_back(token_store.TokenStore(store.chunks, forged, store.manifest, store.seal, 2)).collect()}
    assert not got[0] and got[4]
    short = token_store.TokenStore(store.chunks, store.recipes, store.manifest.where(f"part <> {first}"), store.seal, 2)
    assert not any(r.verified for r in token_store.read_back(short).collect())


def test_token_store_of_nothing(spark):
    assert token_store.read_back(token_store.write_store(documents(spark, []), WORD_BPE, 2, scratch.new_path(spark, "t"))).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 49000, 20000).astype("<u2")
    a = {ids[s:e].tobytes() for s, e in zip([0, *token_store.chunk_ends(ids)], token_store.chunk_ends(ids))}
    moved = np.concatenate([ids[:7], ids])
    b = {moved[s:e].tobytes() for s, e in zip([0, *token_store.chunk_ends(moved)], token_store.chunk_ends(moved))}
    assert len(a & b) > 0.9 * len(a)
    assert token_store.crc32_joined(zlib.crc32(b"abc"), zlib.crc32(b"defgh"), 5) == zlib.crc32(b"abcdefgh")


def jaccard_by_force(texts, percent=80):
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(table))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(30, 200), 3000) for _ in range(25)]
    texts = list(ODD) + ["one two", "One TWO", "one two three four five"]
    for b in base:
        w = b.split()
        texts.append(b)
        for _ in range(rng.randrange(0, 14)):
            v = list(w)
            for _ in range(rng.randrange(0, max(2, len(v) // 25))):
                v[rng.randrange(len(v))] = f"edit{rng.randrange(10**6)}"
            cut = rng.randrange(0, len(v) // 8 + 1)
            texts.append(" ".join(v[cut:]).upper() if rng.random() < 0.3 else " ".join(v[cut:]))
    passage = prose(rng, 60)
    texts += [prose(rng, 40, 9999) + " " + passage for _ in range(40)] + [passage + " " + prose(rng, 3, 9999) for _ in range(12)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(documents(spark, texts)).collect())
    assert got == jaccard_by_force(texts)


def test_jaccard_writes_copies_once(spark, monkeypatch):
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.choice([3, 12, 30]))) for _ in range(20)]
    texts = [*base, "", None, *base, *base, base[2] + " x"]
    met, plain = spark.sparkContext.accumulator(0), jaccard._prefixes

    def counted(*args):
        prefixes = plain(*args)

        def run(batches):
            def each():
                for batch in batches:
                    met.add(batch.num_rows)
                    yield batch

            return prefixes(each())

        return run

    monkeypatch.setattr(jaccard, "_prefixes", counted)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(documents(spark, texts)).collect())
    assert got == jaccard_by_force(texts)
    assert met.value == len({*base, base[2] + " x"})  # of 63 rows


def test_jaccard_of_sets_that_share_names(spark):
    """First names of 4 bits, which dozens of sets share: the second name tells them apart."""
    rng = random.Random(8)
    texts = list(ODD)
    for _ in range(30):
        w = prose(rng, 60, 2000).split()
        texts += [" ".join(w), " ".join(w[2:]), " ".join(w)]
    found = jaccard.JaccardJoin(documents(spark, texts), name_bits=4).run()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == jaccard_by_force(texts)


def test_jaccard_of_nothing_and_of_equal_ids(spark):
    assert jaccard.jaccard_join(documents(spark, [])).count() == 0
    rng = random.Random(4)
    a, b = prose(rng, 50), prose(rng, 50, 9999)
    rows = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (None, a)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_join(rows).collect()}
    assert (2, 1) in got and (3, 1) in got


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i != 20] + [(100, 0), (7, 7)], "a long, b long")
    got = dict(jaccard.components(edges).collect())
    assert {got[i] for i in range(0, 21)} == {0} and got[100] == 0 and {got[i] for i in range(21, 41)} == {21}


def test_quality_statistics_equal_brute_force(spark):
    rng = random.Random(5)
    lines = ["a b c", "", " ", "x", "a b c", "# $ | <", "w w w w", "é ü"]
    texts = ODD + ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 30))) for _ in range(80)] + [prose(rng, 80, 12) for _ in range(10)]
    out = {r.doc_id: r for r in quality.judge(documents(spark, texts).select("doc_id", "text"), np.zeros(0)).collect()}
    for i, t in enumerate(texts):
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        c = collections.Counter(zip(w, w[1:], w[2:]))
        marked = {k + j for k in range(len(w) - 2) if c[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        worded = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), len(worded) - len(set(worded)), len(marked))
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)


def test_quality_model_tells_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.op3_quality(spark, sf_dir).join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    none = labels.where("quality = 7")
    assert quality.judge(docs.select("doc_id", "text"), quality.train(docs, none)).where("kept = base_failed").count() == 0
    assert quality.keep_good(docs.limit(0), labels).count() == 0


CLASHING = ["kept", "good", "n_words", "base_failed", "score", "row", "h", "f", "id", "id0", "k0", "block", "slot", "place", "label", "x"]


def test_filters_keep_columns_whatever_their_names(spark):
    texts = [*ODD, prose(random.Random(30), 90, 4000)]
    docs = documents(spark, texts)
    for i, c in enumerate(CLASHING):
        docs = docs.withColumn(c, F.lit(i))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    for kept in (quality.keep_good(docs, labels), toxicity.keep_civil(docs, labels), jaccard.without_copies(docs)):
        assert kept.columns == docs.columns
        assert all(r.kept == 0 and r.x == len(CLASHING) - 1 for r in kept.collect())
    judged = quality.judge(docs, np.zeros(0))
    assert len(set(judged.columns)) == len(judged.columns) and judged.count() == docs.count()
    assert quality.keep_good(docs.limit(0), labels.limit(0)).count() == 0 and jaccard.without_copies(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(31)
    a, b = prose(rng, 60, 9999), prose(rng, 60, 9999)
    near = " ".join(a.split()[:-2] + ["other", "end"])
    rows = spark.createDataFrame([(1, a), (1, b), (2, near), (None, a), (None, prose(rng, 60, 9999)), (3, b.upper()), (1, a), (7, None), (7, ""), (8, " ")], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "")[:9]) for r in jaccard.without_copies(rows).collect())
    assert got == sorted([(1, a[:9]), (1, b[:9]), (-1, got[0][1]), (7, ""), (7, ""), (8, " ")])


@pytest.mark.parametrize("edits", [4, 9])
def test_jaccard_of_a_large_group_of_near_copies(spark, edits):
    """Copies of one text with random edits: most are linked with few edits, few with many; sizes and places differ."""
    rng = random.Random(32 + edits)
    base = prose(rng, 150, 9999).split()
    texts = [" ".join(base)]
    for i in range(500):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w[rng.randrange(8) :] + [f"t{i}"] * rng.randrange(6)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(documents(spark, texts)).collect())
    assert got == jaccard_by_force(texts)


def test_toxicity_finds_marked_words(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioubdklmnprst") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    plain = [" ".join(rng.choice(words) for _ in range(rng.randrange(60, 400))) for _ in range(400)]
    toxic = []
    for t in plain[:200]:
        w = t.split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(["nastyword", "vileword", "grudgex" + rng.choice("abcdef")]))
        toxic.append(" ".join(w))
    texts = toxic + plain[200:] + ODD
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i < 200)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels.where(~toxicity.is_held_out()))
    held = toxicity.score(docs.select("doc_id", "text"), model).where(toxicity.is_held_out()).where("doc_id < 400").collect()
    assert np.mean([(r.score >= 0.3) == (r.doc_id < 200) for r in held]) > 0.95
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.keep_civil(docs, labels).columns == docs.columns


def test_language_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language.op10_language(spark, sf_dir).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    model = language.train(docs)
    odd = language.classify(documents(spark, ODD).select("doc_id", "text"), model).collect()
    for r in odd:
        if not ODD[r.doc_id] or not any(map(str.isalpha, ODD[r.doc_id])):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        assert 0 <= r.score <= 1
    assert language.train(docs.limit(0)) == {}
    assert {r.lang_pred for r in language.classify(docs.select("doc_id", "text").limit(5), {}).collect()} == {"und"}


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 16)) + 3 * rng.normal(size=(10, 16))[rng.integers(0, 10, 1500)]
    x[100:400] = x[0]  # a third of a cell is one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype("float32"))]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [None] + [1.0] * 15), (2003, [float("nan")] + [1.0] * 15), (2004, [1.0] * 3), (2005, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 20 = 0"), 20, share=0.5, block=200).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    v = x.astype("float32").astype(float)
    hits = total = 0
    for q in range(0, 1500, 20):
        s = v @ v[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        hits += len({m[1] for m in mine} & set(best.tolist()))
        total += 20
    assert hits / total >= 0.9 and not any(k >= 2000 for k in got)
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_nearest_recall_of_the_index_as_it_is_used():
    """Recall at the default share on vectors without structure, on few dimensions and with clusters, by the same walk."""
    rng = np.random.default_rng(40)
    for x in (rng.normal(size=(6000, 64)), rng.normal(size=(6000, 16)), rng.normal(size=(60, 32))[rng.integers(0, 60, 6000)] + 0.1 * rng.normal(size=(6000, 32))):
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        half = x.shape[1] // 2
        a, b = ann._kmeans(x[:, :half], ann.CENTROIDS), ann._kmeans(x[:, half:], ann.CENTROIDS)
        cell = ann._distances(x[:, :half], a).argmin(1) * len(b) + ann._distances(x[:, half:], b).argmin(1)
        sizes = np.bincount(cell, minlength=len(a) * len(b))
        hits, looked = [], []
        for q in range(0, 6000, 100):
            scores = x @ x[q]
            scores[q] = -9
            best = np.argsort(-scores)[:20]
            cells = ann.walk_cells(ann._distances(x[q : q + 1, :half], a)[0], ann._distances(x[q : q + 1, half:], b)[0], sizes, max(ann.CANDIDATES_EACH * 20, int(ann.SHARE * len(x))) + 1)
            hits.append(np.isin(cell[best], cells).mean())
            looked.append(sizes[cells].sum() / len(x))
        assert np.mean(hits) >= 0.9 and np.mean(looked) < 0.6


def test_nearest_query_against_brute_force(spark):
    """The registered query at its own parameters on a table where the index leaves out more than half."""
    got = collections.defaultdict(list)
    for r in ann.op7_nearest(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect() if r.embedding is not None]
    rows = [(i, v) for i, v in rows if len(v) and np.isfinite(v).all() and (v != 0).any()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found = total = 0
    for i, v in rows:
        if i % 20 == 0:
            scores = (x * v).sum(1)
            best = [int(j) for j in ids[np.lexsort((ids, -scores))] if j != i][:20]
            mine = sorted(got[i])
            assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(float(x[ids == j][0] @ v) - s) < 1e-9 for _, j, s in mine)
            found += len({j for _, j, _ in mine} & set(best))
            total += 20
    assert found / total >= 0.9


def test_nearest_ties_go_to_smaller_ids(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.5] if i % 3 else [0.2, 1.0]) for i in range(300)], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in ann.search(vectors, vectors.where("vec_id = 1"), 10).orderBy("rank").collect()]
    assert got == [2, 4, 5, 7, 8, 10, 11, 13, 14, 16]


def test_packing_places_every_piece(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    texts = ODD + [prose(rng, rng.randrange(1, 900)) for _ in range(150)]
    docs = documents(spark, texts).unionByName(documents(spark, texts).where("doc_id = 20"))
    tok = Tokenizer.from_file(BYTE_BPE)
    want = collections.Counter()
    for i in [*range(len(texts)), 20]:
        ids = np.array([*(tok.encode(texts[i], add_special_tokens=False).ids if texts[i] else []), 2], "<u4")
        for p, (a, n) in enumerate(packing.piece_bounds(len(ids))):
            want[i, p, a, n, zlib.crc32(ids[a : a + n].tobytes())] += 1
    for block, spare in ((64, 0.03), (packing.BLOCK, 0.005)):
        rows = packing.pack(docs, BYTE_BPE, 2, block=block).collect()
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        bins = collections.defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            assert at <= 1024
        short = np.array([r.length for r in rows if r.length < 1024])
        assert len(bins) <= (1 + spare) * (len(rows) - len(short) + packing.lower_bound(short)) + 1
    assert packing.pack(documents(spark, []), BYTE_BPE, 2).count() == 0


@pytest.mark.parametrize("named", [{}, {"keep_order": True}])
def test_packing_joins_pieces_of_homogeneous_blocks(spark, named):
    # the input is grouped by length: pieces of 58 only pair with pieces of 39, which come last; pairs stay below LOOSE
    rows = [(i, " a" * (57 if i < 320 else 38), "en", "s", 0) for i in range(640)]
    got = packing.pack(spark.createDataFrame(rows, DOCS).coalesce(1), BYTE_BPE, 2, capacity=100, block=64, **named).collect()
    assert collections.Counter(r.length for r in got) == {58: 320, 39: 320}
    assert len({r.sequence_id for r in got}) == 320


def test_what_a_block_has_over_its_bound_goes_on():
    fill = [(99, b) for b in range(150)]
    assert packing.leaving(fill, 150, 100)[0] == {0}
    assert packing.leaving(fill, 149, 100) == (set(range(100)), set(range(37)))
    assert packing.leaving([(10, 0), (20, 1), (50, 2), (60, 3)], 4, 100)[0] == {0, 1, 2, 3}


def test_evolution_beats_or_equals_best_fit_decreasing():
    rng = np.random.default_rng(9)
    lengths = sorted(rng.integers(250, 480, 200).tolist(), reverse=True)
    free = []
    packing.best_fit(free, list(range(200)), lengths, 1024)
    bound = packing.lower_bound(np.array(lengths))
    n, _, assigned = packing.evolve(lengths, None, 1, bound, generations=20)
    assert bound <= n <= len(free)
    fill = np.bincount(assigned, weights=lengths)
    assert len(fill) == n and fill.max() <= 1024
    assert packing.lower_bound(np.array([600, 600, 600])) == 3


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(10)
    lengths = np.sort(rng.integers(1, 700, 500))[::-1]
    pool = []
    for _ in range(2):
        free, place = [], np.zeros(500, np.int64)
        order = rng.permutation(500)
        place[order] = packing.best_fit(free, order.tolist(), lengths.tolist(), 1024)
        pool.append((place, np.array(free)))
    for _ in range(30):
        place, free = packing.crossover(*pool, lengths.tolist(), 1024, rng)
        fill = np.bincount(place, lengths, len(free))
        assert (fill == 1024 - free).all() and free.min() >= 0 and fill.min() > 0
        pool = [pool[1], (place, free)]


def edf_by_force(b):
    """Order of sources of one cycle, by a plain simulation."""
    d, done, out = sum(b), [0] * len(b), []
    for t in range(d):
        ready = [(-(-(done[i] + 1) * d // x), i) for i, x in enumerate(b) if done[i] < x and done[i] * d // x <= t]
        i = min(ready)[1]
        done[i] += 1
        out.append(i)
    return out


def test_mixing_follows_deadlines(spark):
    counts = {None: 3, "a": 400, "b": 90, "c": 37, "d": 1}
    rows = [(i, s) for i, s in enumerate([s for s, n in counts.items() for _ in range(n)])]
    docs = spark.createDataFrame(rows + [(5, "a")], "doc_id long, source string").selectExpr("*", "'x' as i", "1 as block_")
    out = mixing.schedule(docs, {"a": 0.5, "b": 0.3, "c": 0.2}, block_docs=4, cycle=20)
    got = out.collect()
    assert len(got) == len(rows) + 1 and out.columns == [*docs.columns, "block", "slot", "place"]
    slots = {}
    for r in got:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert sorted(slots) == list(range(len(slots)))
    counts["a"] += 1
    names = [None, "a", "b", "c", "d"]
    n = {s: -(-counts[s] // 4) for s in names}
    weight = {None: 0.2, "a": 0.5, "b": 0.3, "c": 0.2, "d": 0.2}
    w = {s: max(1, round(weight[s] / sum(weight.values()) * 20)) for s in names}
    want, cycle = [], 0
    while any(n[s] > cycle * w[s] for s in names):
        b = [max(0, min(w[s], n[s] - cycle * w[s])) for s in names]
        order = edf_by_force(b)
        taken = collections.Counter()
        for t, i in enumerate(order):
            taken[i] += 1
            assert all(abs(taken[j] - (t + 1) * b[j] / sum(b)) < 1 for j in range(5))
            want.append((names[i], cycle * w[names[i]] + taken[i] - 1))
        cycle += 1
    assert [slots[t] for t in sorted(slots)] == want
    assert mixing.schedule(docs.limit(0)).count() == 0


def fluid_by_force(n, w, slots):
    """What has flowed of every source after each slot, where a source that has run out leaves its share to the others."""
    out, flowed = [], [0.0] * len(n)
    for _ in range(slots):
        need = 1.0
        while need > 1e-12:
            live = [i for i in range(len(n)) if n[i] - flowed[i] > 1e-9]
            if not live:
                break
            rate = sum(w[i] for i in live)
            step = min([need / rate] + [(n[i] - flowed[i]) / w[i] for i in live])
            for i in live:
                flowed[i] += w[i] * step
            need -= step * rate
        out.append(list(flowed))
    return out


def test_mixing_is_within_a_block_of_exact_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "JOB_SLOTS", 300)
    monkeypatch.setattr(mixing, "FOLD_SLOTS", 64)
    monkeypatch.setattr(mixing, "GROUP", 50)
    roots = {f"s{k:03}": 130 if k else 1300 for k in range(21)}  # square roots: no whole hundredths
    many = {f"s{k:03}": 700 if not k else 3 + k % 7 for k in range(160)}
    heavy = {name: 1 / 3 if name == "s000" else 2 / 3 / 159 for name in many}
    spent = {"a": 40, "b": 700, "c": 9, "d": 30}
    for counts, weights in ((roots, None), (many, heavy), (spent, {"a": 2**0.5, "b": 1.0, "c": 0.0, "d": 3.0})):
        docs = spark.createDataFrame([(i, s) for i, s in enumerate([s for s, k in counts.items() for _ in range(k)])], "doc_id long, source string")
        slots, seen = {}, set()
        for r in mixing.schedule(docs, weights, block_docs=2).collect():
            assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
            seen.add(r.doc_id)
        names = sorted(counts)
        n = [-(-counts[s] // 2) for s in names]
        wanted = [weights[s] if weights else counts[s] ** 0.5 for s in names]
        assert len(seen) == sum(counts.values()) and sorted(slots) == list(range(sum(n)))
        taken, first_end = collections.Counter(), min(k / x * sum(wanted) for k, x in zip(n, wanted, strict=True) if x)
        for t, flowed in enumerate(fluid_by_force(n, [x or 1e-15 for x in wanted], sum(n))):
            assert slots[t][1] == taken[slots[t][0]]
            taken[slots[t][0]] += 1
            assert all(abs(taken[s] - f) < 1 + 1e-6 for s, f in zip(names, flowed, strict=True))
            if t + 1 <= first_end:
                assert all(abs(taken[s] - (t + 1) * x / sum(wanted)) < 1 + 1e-6 for s, x in zip(names, wanted, strict=True))


def test_url_filter_rules(spark):
    urls = ["http://a.example.net/en/1", "https://EXAMPLE.com/de/x?y", "http://x.org/fr/", "http://x.org/fr", "http://sub.free-bets.example.com/fr/a", "http://net/", "http://net", None, "nothing", "http://h.net#a", "ftp://a.b.c.example.com/de/1/2#z", "http://evilexample.com/de/", "://", "http://q.example.net/en/1://x", "http://a.org/fr/\0secret/x", "http://b\0c.net/y\n/z?q", "http://" + "l." * 300 + "net/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + urls[:1])], "page_id long, url string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.BLOCK_RULES, url_filter.ALLOW_RULES, spark.createDataFrame([(h,) for h in url_filter.LISTED_HOSTS], "key string")).collect()}
    assert len(got) == len(urls) + 1
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("example.com", "/de/x", "example.com/de/", "block")
    assert got[2][2:] == ("org/fr/", "allow") and got[3][2:] == (None, "allow")
    assert got[4][2:] == (None, "block") and got[5][2:] == ("net/", "block") and got[6] == ("net", "", None, "allow")
    assert got[7] == got[8] == ("", "", None, "allow") and got[9][:2] == ("h.net", "")
    assert got[10][2] == "example.com/de/" and got[11][2] is None and got[12][:2] == ("", "")
    assert got[14] == ("a.org", "/fr/\0secret/x", "org/fr/", "allow") and got[15] == ("b\0c.net", "/y\n/z", "net/", "block") and got[16][2] == "net/"
    assert url_filter.judge_urls(pages.limit(0), [], [], spark.createDataFrame([], "key string")).count() == 0


@pytest.mark.parametrize("shard_bits", [url_filter.SHARD_BITS, 9])
def test_cascade_is_exact(spark, monkeypatch, shard_bits):
    monkeypatch.setattr(url_filter, "SHARD_BITS", shard_bits)
    universe = spark.range(6000).selectExpr("concat('k', id) as key")
    listed = spark.range(9000).where("id % 3 = 0").selectExpr("concat('k', id) as key")
    cascade = url_filter.Cascade.build(universe, listed)
    assert len(cascade.levels) > 1
    wrong = universe.withColumn("in", cascade.holds(universe["key"])).where("`in` <> (cast(substring(key, 2) as int) % 3 = 0)")
    assert wrong.count() == 0
    path = scratch.new_path(spark, "cascade")
    cascade.save(path)
    again = url_filter.Cascade.load(spark, path)
    assert [(x.bits, x.seed) for x in again.levels] == [(x.bits, x.seed) for x in cascade.levels]
    assert universe.where(again.holds(universe["key"])).count() == 2000


def test_license_scan(spark):
    mit = ". ".join(license_scan.SENTENCES[i] for i in (8, 9)) + "."
    texts = ["Released under the MIT License.\nx", f"Intro here.\n{mit}\nEnd", "Licensed under the Apache License, Version 2.0. All rights reserved.", "license but none", "", None, "Licensed under CC BY-NC 4.0.\n" * 3, "x" * 10000]
    got = {r.doc_id: (r.licences, r.n_sentences, r.first_sentence) for r in license_scan.scan(documents(spark, texts)).collect()}
    assert got[0] == ("MIT", 1, 0) and got[1] == ("MIT", 2, 1) and got[2] == ("Apache-2.0; proprietary", 2, 0)
    assert got[3] == got[4] == got[5] == got[7] == ("", 0, None) and got[6] == ("CC-BY-NC-4.0", 3, 0)


def test_license_scan_of_wrapped_notices(spark):
    mit = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
    apache = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law"""
    gpl = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */"""
    apart = "Redistribution and use in source and binary forms, with or without\n\nmodification, are permitted provided that the following conditions are met:"
    flat = apache[2:].replace("\n# ", " ")
    texts = [mit, bsd, apache, gpl, apart, "x not released under the MIT\nLicense.", "Released under the MIT\r\nLicense. More", flat, "All" + " -" * 5000 + " rights reserved"]
    got = {r.doc_id: (r.licences, r.n_sentences) for r in license_scan.scan(documents(spark, texts)).collect()}
    assert got == {0: ("MIT", 3), 1: ("BSD", 2), 2: ("Apache-2.0", 3), 3: ("GPL-3.0", 1), 4: ("", 0), 5: ("", 0), 6: ("MIT", 1), 7: ("Apache-2.0", 3), 8: ("proprietary", 1)}


def test_license_scan_over_gaps_of_any_length(spark):
    words = license_scan.SENTENCES[8].split()
    other = license_scan.SENTENCES[9].split()
    texts = [f"{(' ' * n).join(words)}.\n{('*' * n).join(other)}." for n in (1, 199, 250, 20000)]
    got = [r.licences for r in license_scan.scan(documents(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["MIT"] * 4
    wrapped = [words[0] + " " * 300 + "\n" + " " * 300 + " ".join(words[1:]) + ".\n" + " ".join(other) + "."]
    assert license_scan.scan(documents(spark, wrapped)).first().licences == "MIT"


def test_urls_of_very_long_hosts(spark):
    long = "a." * 50_000
    urls = [f"http://{long}net/x", f"http://{long}spam-farm.example.com/", f"http://{long}example.net/en/x", f"http://{long}example.com", f"http://{long}"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("spam-farm.example.com",)], "key string")
    got = [(r.rule, r.verdict, r.listed) for r in url_filter.judge_urls(pages, url_filter.BLOCK_RULES, url_filter.ALLOW_RULES, listed).orderBy("page_id").collect()]
    assert got == [("net/", "block", False), (None, "block", True), ("example.net/en/", "allow", False), (None, "allow", False), (None, "allow", False)]
    deep = spark.createDataFrame([("b.c.d.e.f.org",)], "key string")  # longer than any rule's host
    assert [r.verdict for r in url_filter.judge_urls(spark.createDataFrame([(0, "ftp://a.b.c.d.e.f.org/")], "page_id long, url string"), [], [], deep).collect()] == ["block"]


def test_license_scan_of_whole_licences(spark):
    bsd3 = """BSD 3-Clause License

Copyright (c) 2021, Someone. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
    bsd2 = bsd3[: bsd3.index("3. Neither")]
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.\n"
    lgpl = "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007\n"
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n"
    texts = [bsd3, bsd2, mpl, lgpl, apache, "/* SPDX-License-Identifier: BSD-3-Clause */\nint main() {}", "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", "CC0 1.0 Universal"]
    got = [r.licences for r in license_scan.scan(documents(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["BSD-3-Clause; proprietary", "BSD-2-Clause; proprietary", "MPL-2.0", "LGPL-3.0", "Apache-2.0", "BSD-3-Clause", "CC-BY-SA-4.0", "CC0-1.0"]
    assert license_scan.scan(documents(spark, [])).count() == 0
    odd = documents(spark, ["MIT License"]).withColumn("licences", F.lit(1)).withColumn("ids", F.lit(2)).withColumn("seq", F.lit(3))
    assert license_scan.scan(odd).first().licences == "MIT"


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    at = docs
    for i, (name, stage) in enumerate(P.STAGES):
        before, at = at, scratch.stage(stage(spark, at, sf_dir), f"stage{i}")
        if i < len(P.STAGES) - 1:
            assert at.columns == docs.columns, name
            ids = {r.doc_id for r in at.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "n-gram Jaccard join":
            rows = sorted(before.collect(), key=lambda r: r.doc_id)
            force = jaccard_by_force([r.text for r in rows])
            assert ids == {rows[i].doc_id for i, _, c in force if i == c}
        if name == "source mixing":
            assert at.count() == before.count()
    assert {r.doc_id for r in at.collect()} == ids
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(ids & toxic) <= 0.25 * len(toxic)
    assert P.run(spark, sf_dir).count() == at.count()


def test_pipeline_stages_on_odd_and_empty_tables(spark, sf_dir):
    import corpus_pipeline as P

    texts = [*ODD, *ODD, prose(random.Random(50), 80, 5000)]
    odd = documents(spark, texts).withColumn("_kept", F.lit(1)).withColumn("score", F.lit("x"))
    odd = odd.withColumn("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("doc_id"))).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.col("source")))
    for i, (name, stage) in enumerate(P.STAGES):
        got = scratch.stage(stage(spark, odd, sf_dir), f"odd{i}")
        assert stage(spark, odd.limit(0), sf_dir).count() == 0, name
        if i < len(P.STAGES) - 1:
            assert got.columns == odd.columns, name
            assert got.count() == (len(texts) if name == "source mixing" else got.count()) <= len(texts)
        else:
            assert {r.piece for r in got.where("doc_id = 3").collect()} == {0}
