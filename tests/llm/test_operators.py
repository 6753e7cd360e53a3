"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from convoke.llm import counts, fingerprints, jaccard, language, packing, quality, queries, rans, repeats, token_files, tokens, transducer, vectors
from convoke.llm.components import components
from convoke.llm.scratch import Scratch
from tests import compare

VOCABULARY = [f"w{i}" for i in range(40)]


def sample(seed: int = 3, n: int = 120) -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, empty, blank, short and one very long text."""
    rng = random.Random(seed)
    word = lambda k: " ".join(rng.choices(VOCABULARY, k=k))
    passage, texts = word(30), []
    for i in range(n):
        kind = i % 8
        if kind == 0 or not texts:
            t = word(rng.randint(1, 90))
        elif kind == 1:
            t = rng.choice(texts)
        elif kind == 2:
            w = (rng.choice(texts) or "x").split()
            w[rng.randrange(len(w))] = "changed" if w else "x"
            t = " ".join(w)
        elif kind == 3:
            t = f"{word(10)}\n{passage}\t{word(10)}"
        else:
            t = word(rng.randint(1, 60)).replace(" ", "  \n") if kind == 4 else word(rng.randint(13, 50)).upper()
        texts.append(t)
    texts += [None, "", "   \n", "one", "two words", "é 漢字 ▁ \x0b end", word(30_000)]
    return [(i * 3, t, "en", "src", -1, 1, "r") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket int, rest string").repartition(5)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def words(t):
    return (t or "").encode().split()


def test_repeats(spark, docs, rows):
    first, expected = {}, {}
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        expected[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    out = repeats.remove_repeats(spark, docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out} == expected
    assert any(n for _, n, _ in expected.values())
    for r in out:
        assert sum(b - a for a, b in r["spans"]) == r["n_removed"] and r["rest"]["rest"] == "r"


def test_repeats_odd_rows(spark, empty):
    assert repeats.remove_repeats(spark, empty).count() == 0
    t = " ".join(VOCABULARY[:15])
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (1, "short")], "doc_id long, text string")
    out = sorted((r["doc_id"] or 99, r["n_removed"]) for r in repeats.remove_repeats(spark, df).collect())
    assert out == [(1, 0), (5, 0), (5, 0), (99, 15)]


def sets_of(rows):
    out = {}
    for i, t, *_ in rows:
        w = [bytes(c + 32 if 65 <= c < 91 else c for c in x) for x in words(t)]
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    return out


def brute_components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard(spark, docs, seed):
    rows = sample(seed)
    df = spark.createDataFrame(rows, docs.schema)
    sets = sets_of(rows)
    root = brute_components(sets)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark, df).collect()}
    assert out == {i: (len(sets[i]), root[i]) for i in sets}


def test_jaccard_odd_rows(spark, empty):
    assert jaccard.jaccard_components(spark, empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (2, None)], "doc_id long, text string")
    out = sorted((r["doc_id"] or 99, r["component_id"]) for r in jaccard.jaccard_components(spark, df).collect())
    assert out == [(2, 2), (7, 7), (7, 7), (99, None)]


def test_jaccard_different_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (2, a + " more"), (9, b + " more"), (6, b), (1, c), (1, "only this one"), (8, c), (None, a), (7, None), (7, "d e")]
    out = jaccard.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r["doc_id"] or 99, r["n_shingles"], r["component_id"]) for r in out)
    # the rows of 5 are like 2, and like 6 and 9, which are a component of which 5 is the smallest
    assert found == [(1, 1, 1), (1, 36, 1), (2, 37, 2), (5, 36, 2), (5, 36, 2), (5, 36, 2), (6, 36, 5), (7, 0, 7), (7, 1, 7), (8, 36, 1), (9, 37, 5), (99, 36, None)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (5, 5), (100, 90)]
    out = components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "t")
    root = {r["node"]: r["root"] for r in out.collect()}
    assert root == {**{i: 0 for i in range(61)}, 100: 90, 90: 90, 95: 90}


def test_counts(spark, docs, empty, sf_dir):
    assert compare.difference(spark, compare.connect(sf_dir), sf_dir, queries.QUERIES["word_counts"], queries.SQL["word_counts"]) == ""
    roll = counts.Rollup(spark, Scratch(spark, "counts").base)
    assert roll.totals().count() == 0 and not roll.compact()
    one = counts.counted(docs.unionByName(docs), "words_v1")  # repeated rows count as often
    assert roll.commit("a", counts.delta(inserts=one)) and not roll.commit("a", counts.delta(inserts=one))
    total = roll.totals().first()
    assert total["n_tokens"] == one.agg(F.sum("n_tokens")).first()[0] and total["n_docs"] == 2 * docs.count()
    assert roll.compact() and not roll.compact() and roll.totals().collect() == [total]
    roll.commit("b", counts.delta(deletes=one))
    assert roll.totals().count() == 0 and roll.committed() == ["a", "b"]
    roll.commit("c", counts.delta(inserts=counts.counted(empty, "words_v2")))
    assert roll.compact() and roll.totals().count() == 0


def test_counts_of_tokens(spark, sf_dir):
    """Against the library, by document."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in table.collect()]
    expected = {}
    for version, of in (("byte_bpe_50k", lambda i: i % 10 not in (3, 7)), ("word_bpe_49k", lambda i: i % 10 == 7)):
        t = Tokenizer.from_file(public_tokenizers.path(f"{version}.json"))
        for i, text, source, lang in rows:
            if of(i):
                have = expected.setdefault((source, lang, version), [0, 0, 0])
                for k, n in enumerate((1, len(text or ""), len(t.encode(text or "", add_special_tokens=False).ids))):
                    have[k] += n
    out = queries.QUERIES["op2_token_counts"](spark, sf_dir).collect()
    assert {(r["source"], r["lang"], r["tokenizer_version"]): [r["n_docs"], r["n_chars"], r["n_tokens"]] for r in out} == expected
    odd = spark.createDataFrame([(None, None, None, None), (1, "<|endoftext|>", "s", None), (1, "", "s", None)], "doc_id long, text string, source string, lang string")
    got = counts.counted(odd, "v", public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"] or 0, r["n_docs"], r["n_chars"], r["n_tokens"]) for r in got) == [(0, 1, 0, 0), (1, 1, 0, 0), (1, 1, 13, 1)]


def test_counts_of_two_writers(spark, docs):
    """Both write the same id; the one that publishes first wins, and the other's delta is hidden."""
    roll = counts.Rollup(spark, Scratch(spark, "counts").base)
    one = counts.delta(inserts=counts.counted(docs, "words_v1"))
    one.write.parquet(f"{roll.path}/batch=a/_attempt-late")
    assert roll.committed() == [] and roll.totals().count() == 0  # an attempt that isn't published, as of a lost driver
    assert roll.commit("a", one)
    total = roll.totals().collect()
    exists, roll.fs = roll.fs, type("Unaware", (), {"exists": lambda _, p: False, "rename": lambda _, a, b: exists.rename(a, b)})()
    roll._publish("batch=a", "_attempt-late")  # does not see that it comes second
    roll.fs = exists
    assert roll.committed() == ["a"] and roll.totals().collect() == total


def test_fingerprints(spark, docs, rows, empty):
    out = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(spark, docs).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t, *_) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (out[i]["n_chars"], out[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        [own] = fingerprints.fingerprints([t.encode()])
        assert out[i]["fingerprint"] == own.text() and 0 <= out[i]["near_next"] <= 1
    by_text = {}
    for i, t, *_ in rows:
        assert by_text.setdefault(t or "", out[i]["fingerprint"]) == out[i]["fingerprint"]
    assert len(set(by_text.values())) == len(by_text)
    assert fingerprints.edited_fingerprints(spark, empty).count() == 0


def test_fingerprints_are_homomorphic():
    a, b, ab, ba = fingerprints.fingerprints([b"one two three four", b"five six", b"one two three four\nfive six", b"five six\n\none two three four"])
    assert (a + b).same_paragraphs(ab) and ab.same_paragraphs(ba) and (ab - b).same_paragraphs(a) and not a.same_paragraphs(b)
    assert ab.likeness(ba) == 1 and 0 < a.likeness(ab) < 1 and ab.text() != ba.text()
    assert fingerprints.Fingerprint.of_text(ab.text()).text() == ab.text()


@pytest.mark.parametrize("n", [32_768, 65_536, 100_000])
def test_fingerprints_of_a_run_that_recurs(n):
    a, b = fingerprints.fingerprints([b"one two three\n" * n, b"one two three\n" * n + b"another short line"])
    assert a.likeness(b) > 0.99 and b.likeness(fingerprints.Fingerprint.of_text(a.text())) > 0.99 and (b - a).likeness(a) < 0.5


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    out = queries.QUERIES["op5_quality"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert ((out["predicted"] == 1) == (out["quality"] == 1)).mean() > 0.95
    assert ((out["predicted"] == 0) & (out["quality"] == 0)).sum() > 0.8 * (out["quality"] == 0).sum()


def test_quality_odd_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality_scores(spark, docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (6, None), (9, 1)], "doc_id long, quality int")
    assert quality.quality_scores(spark, docs, some).where("score between 0 and 1").count() == docs.count()
    assert quality.quality_scores(spark, empty, some).count() == 0


def test_rules_compile(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality.STATS)))
    y = ((x[:, 4] > 0.5) & (x[:, 9] < 0.7)).astype(int)
    model = quality.fit(x, y)
    df = spark.createDataFrame([[float(v) for v in r] for r in x], quality.STATS)
    got = np.array([r[0] for r in df.select(model.expression()).collect()])
    z = sum((w * quality.holds(x, r) for r, w in zip(model.rules, model.weights, strict=True)), np.full(400, model.base))
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and ((got > 0.5) == y).mean() > 0.95 and len(model.rules) < 200


def test_language_held_out(spark):
    d = "/root/testdata/sf0.1"
    out = queries.QUERIES["op7_language"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97


def test_language_odd_rows(spark, docs, empty):
    out = {r["doc_id"]: r for r in language.languages(spark, docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))).collect()}
    assert out[360]["lang_pred"] == out[363]["lang_pred"] == out[366]["lang_pred"] == "und" and out[0]["lang_pred"] == "en"
    assert language.languages(spark, empty).count() == 0
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.languages(spark, nothing).collect()} == {"und"}


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    v = [b + rng.standard_normal(16) * s for b in base[:30] for s in (0, 0, 0.02, 0.05)] + list(base[30:])
    rows = [(i, [float(x) for x in row], i % 2 if i > 40 else 0) for i, row in enumerate(v)]
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = {i: i for i in range(len(rows))}
    for _ in rows:
        root = {i: min([root[i], *(root[int(j)] for j in np.flatnonzero(near[i]))]) for i in root}
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None], 0), (904, [1.0] * 16, None), (905, [], 0), (906, [2.0] * 3, 0), (907, [float("inf")] * 16, 0), (None, [1.0] * 16, 0)]
    out = {r["vec_id"]: r for r in vectors.near_vectors(spark, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")).collect()}
    assert {i: (out[i]["n_links"], out[i]["component_id"]) for i in root} == {i: (int(near[i].sum()), root[i]) for i in root}
    assert near.sum() > 50 and all((out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True) for i in range(900, 908))
    assert out[None]["component_id"] is None and not out[None]["kept"] and len(out) == len(rows) + len(odd)


def test_vectors_recall_near_the_bound(spark):
    """Planted pairs with cosines from 0.97 to 0.99, and a dense family: every link of brute force is found, and no other."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((700, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((700, 32))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.97, 0.99, (700, 1))
    family = base[0] + rng.standard_normal((300, 32)) * 0.025
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * side, family]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    unit = vectors.unit(x.tolist())
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    out = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(spark, df).collect()}
    found = np.array([out[i] for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9999 * near.sum() and near[:1400, :1400].sum() > 500


def test_different_vectors_of_one_id(spark):
    rng = np.random.default_rng(8)
    a, b, c = rng.standard_normal((3, 16))
    rows = [(5, a), (5, b), (5, b), (2, a + 0.01), (9, b + 0.01), (6, b), (1, c), (1, -c), (8, c)]
    df = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(spark, df).collect())
    assert found == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 2, True), (5, 1, 2, False), (5, 3, 5, True), (5, 3, 5, True), (6, 3, 5, False), (8, 1, 1, False), (9, 3, 5, False)]


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(16)
    rows = [(i, [float(x) for x in base + rng.standard_normal(16) * 0.01], 1) for i in range(50)]
    out = vectors.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r["n_links"], r["component_id"]) for r in out} == {(49, 0)}
    assert vectors.near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


ALPHABET = list("  aeint'sS\n\t é漢😀ﬁ.,!<>0x\x01Σ\x1c▁|") + ["<|endoftext|>", "<|ENDofText|>", "<|startoftext|>", " the", "</s>"]


def odd_texts(n: int) -> list[str]:
    rng = random.Random(8)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens(name, monkeypatch):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    texts = odd_texts(1500)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(path).encode(texts)] == expected
    monkeypatch.setattr(tokens, "CACHE", 50)
    small = tokens.Encoder(path)
    assert [np.frombuffer(small.encode([t])[0], "<u4").tolist() for t in texts[:300]] == expected[:300]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 16384, 65536, 65537, 200_001])
def test_rans(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_000).astype(np.uint32)
    raw = rans.write_file([1, None], np.array([n // 2, n - n // 2], np.uint32), ids)
    docs, count, back = rans.read_file(raw)
    assert docs == [1, None] and count.sum() == n and (back == ids).all()
    if n == 65537:
        table, blocks = rans.Table.of(ids), rans.encode_blocks(ids, rans.Table.of(ids))
        assert len(blocks) == 2 and len(rans.parse_block(blocks[0])[2]) == 4 and len(raw) < 2.2 * n
        bad = bytearray(blocks[0])
        bad[-100] ^= 1
        with pytest.raises(ValueError):
            rans.decode_blocks([bytes(bad)], table)


def library_ids(name, rows, end=2):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for i, x, *_ in rows}


def test_token_files(spark, docs, rows, empty):
    path, name = Scratch(spark, "files").base, public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_files(spark, docs, path, name)
    ids, at = library_ids("byte_bpe_50k.json", rows), 0
    out = {r["doc_id"]: r for r in token_files.read_files(spark, path).collect()}
    for i in sorted(ids):
        assert (out[i]["start"], out[i]["n_tokens"], out[i]["ids_crc32"], bytes(out[i]["ids"])) == (at, len(ids[i]), zlib.crc32(ids[i].tobytes()), ids[i].tobytes())
        at += len(ids[i])
    token_files.write_files(spark, empty, path, name)
    assert token_files.read_files(spark, path).count() == 0


def test_transducer(spark, docs, rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), transducer.Transducer(path)
    texts = odd_texts(3000) + ["", " ", "a" * 3000, "x" + " " * 40 + "y", "  lead", "trail  "]
    assert [np.frombuffer(ours.encode(t), "<u4").tolist() for t in texts] == library.encode(texts)
    assert all(ours.decode(ours.encode(t)) == t.replace("▁", " ") for t in texts)
    back = {r["doc_id"]: r["text"] for r in transducer.decoded(transducer.encoded(docs, path), path).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t, *_ in rows}


@pytest.mark.parametrize("options", [{"normalization_rule_name": "nmt_nfkc"}, {"remove_extra_whitespaces": True}, {"add_dummy_prefix": False}, {}])
def test_transducer_refuses_other_normalisers(tmp_path, options):
    settings = {"normalization_rule_name": "identity", "remove_extra_whitespaces": False} | options
    lines = iter(["some words to learn from", "and a few more words"] * 20)
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=lines, model_prefix=f"{tmp_path}/m", model_type="bpe", vocab_size=300, byte_fallback=True, hard_vocab_limit=False, minloglevel=2, **settings)
    if not options:
        assert transducer.Transducer(f"{tmp_path}/m.model").encode("words")
        return
    with pytest.raises(ValueError):
        transducer.Transducer(f"{tmp_path}/m.model")


def brute_cost(position, penalty, window):
    p, best = [0, *position], [0] + [None] * len(position)
    for i in range(1, len(p)):
        pad = lambda j: window - p[i] + p[j] if i < len(position) else 0
        best[i] = min(best[j] + pad(j) + penalty[i - 1] for j in range(i) if p[i] - p[j] <= window)
    return best[-1]


@pytest.mark.parametrize("seed", range(5))
def test_packing_is_optimal(seed):
    rng = np.random.default_rng(seed)
    position = np.cumsum(rng.integers(1, 20, 60))
    penalty = rng.choice([0, 4, 24], 60)
    ends = packing.cuts(position, penalty, 32)
    cost, at = 0, {int(p): int(c) for p, c in zip(position, penalty, strict=True)}
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        assert b - a <= 32
        cost += at[b] + (32 - (b - a) if b != ends[-1] else 0)
    assert cost == brute_cost(position.tolist(), penalty.tolist(), 32)


def test_packing(spark, docs, rows, empty):
    name = public_tokenizers.path("word_bpe_49k.json")
    ids = library_ids("word_bpe_49k.json", rows)
    for window in (64, 4096):
        out = packing.packed(spark, docs, name, window).toPandas()
        for r in out.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        for i, own in out.sort_values("start").groupby("doc_id"):
            assert own["start"].tolist() == np.append(0, np.cumsum(own["length"])[:-1]).tolist() and own["length"].sum() == len(ids[i])
        assert set(out["doc_id"]) == set(ids)
        pad = total = 0
        for _, own in out.sort_values("offset").groupby("sequence_id"):
            size = int(own["length"].sum())
            assert own["offset"].tolist() == np.append(0, np.cumsum(own["length"])[:-1]).tolist() and size <= window
            pad, total = pad + (0 if size & (size - 1) == 0 else window - size), total + size
        assert pad < 0.08 * total
    assert packing.packed(spark, empty, name).count() == 0
