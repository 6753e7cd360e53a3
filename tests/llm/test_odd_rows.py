"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, in ranges, in operators over them and in the pipeline's stages."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from convoke.llm import fingerprints, language, packing, ranges, rans, token_files
from convoke.llm.scratch import Scratch

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string"


def mixed(n: int = 300) -> list[tuple]:
    """A third without an id, a third of one id, and the rest; with equal rows and a long text."""
    rows = [(None if i % 3 == 0 else 77 if i % 3 == 1 else i * 10**9, f"text number {i} " * (i % 7)) for i in range(n)]
    return [*rows, (5, None), (5, ""), (5, "a <|endoftext|> b"), (5, "a <|endoftext|> b"), (None, "long " * 4000), (-(2**62), "low"), (2**62, "high")]


@pytest.mark.parametrize("size", [500, 4000, 10**7])
def test_ranges(spark, size):
    df = ranges.ordered(spark.createDataFrame(mixed(), SCHEMA))
    out = ranges.ordered_ranges(spark, df.repartition(5), size).collect()
    again = ranges.ordered_ranges(spark, df.repartition(3, "text"), size).collect()
    key = lambda r: (r["bucket"], r["doc_id"] is not None, r["doc_id"] or 0, r["digest"])
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(mixed())
    order = [k[1:] for k in sorted(map(key, out))]
    assert order == sorted(order)
    if size == 500:
        big = {}
        for r in out:
            big.setdefault(r["bucket"], []).append(len(r["text"]) + 1)
        assert max(sum(x) for x in big.values() if max(x) < size) < 3 * size and len(big) > 20
    assert ranges.ordered_ranges(spark, df.limit(0), size).count() == 0


def ordered_rows(spark, rows):
    digest = {r["text"]: r["digest"] for r in ranges.ordered(spark.createDataFrame(rows, SCHEMA)).collect()}
    return sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, digest[r[1]]))


def test_token_files_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE", 700)
    rows, library, path, at = mixed(), Tokenizer.from_file(BYTES), Scratch(spark, "files").base, 0
    token_files.write_files(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), path, BYTES)
    expected = []
    for i, t in ordered_rows(spark, rows):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        expected.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_files(spark, path).collect()) == expected


def test_packing_is_the_same_however_partitioned(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE", 3000)
    df = spark.createDataFrame(mixed(), SCHEMA)
    one, two = (sorted(map(str, packing.packed(spark, d, WORDS, 64).collect())) for d in (df.repartition(7), df.coalesce(1)))
    assert one == two
    t = Tokenizer.from_file(WORDS)
    assert sum(r["length"] for r in packing.packed(spark, df, WORDS).collect()) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in mixed())


@pytest.mark.parametrize("size", [1000, 10**7])
def test_fingerprints_of_repeated_and_null_ids(spark, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "RANGE", size)
    rows = mixed()
    out = fingerprints.edited_fingerprints(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    order = ordered_rows(spark, rows)[::-1]
    expected = []
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        own, new, after = fingerprints.fingerprints([t.encode(), edited.encode(), n.encode()])
        expected.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), own.text(), new.text(), round(own.likeness(new), 9), round(own.likeness(after), 9)))
    got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in out]
    assert sorted(got) == sorted(expected)


def brute_boundaries(ids, doc_end, is_end, window):
    """Where a window may end, by the rule in words: ends of documents and sentences, and every GAP ids where these are far apart."""
    kind = {i + 1: packing.SENTENCE for i, x in enumerate(ids) if is_end[x]} | {int(e): packing.DOCUMENT for e in doc_end if e > 0} | {len(ids): packing.DOCUMENT}
    gap, out, before = min(packing.GAP, window), {}, 0
    for at in sorted(kind):
        if at - before > (2 * gap if window > 2 * gap else gap):
            out |= {p: packing.ELSEWHERE for p in range(before + gap, at, gap)}
        out[at], before = kind[at], at
    return out


@pytest.mark.parametrize("seed", range(4))
def test_boundaries(seed):
    rng = np.random.default_rng(seed)
    is_end = np.arange(100) < (0, 1, 3, 10)[seed]
    ids, doc_end = rng.integers(0, 100, 900), np.unique(np.append(rng.integers(1, 900, 6), 900))
    for window in (16, 32, 64, 4096):
        at, penalty = packing.boundaries(ids, doc_end, is_end, window)
        assert dict(zip(at.tolist(), penalty.tolist(), strict=True)) == brute_boundaries(ids, doc_end, is_end, window)
        assert np.diff(np.append(0, at)).max() <= window


def test_language_profiles_by_definition():
    """Bundles and cosines of a few texts, one n-gram at a time; and the same in blocks of two n-grams."""
    texts = ["Abc abd", "漢字漢字 x", "", "12", "é é é"]
    def vector(t):
        letters = "".join(c if c.isalpha() else " " for c in t.lower())
        s = " " + "".join(w + " " for w in letters.split())
        total = np.zeros(language.DIM)
        for k in range(len(s) - 2):
            g = np.ones(language.DIM)
            for j, c in enumerate(reversed(s[k : k + 3])):
                g *= np.roll(language.letter_vectors(np.array([ord(c)]))[0], j)
            total += g
        return total if len(s) > 1 else np.zeros(language.DIM)
    for block in (language.BLOCK, 2):
        language.BLOCK, had = block, language.BLOCK
        try:
            grams = language.Grams(texts)
            bundles, every = grams.bundles(), grams.bundle_all(list(range(len(texts))))
        finally:
            language.BLOCK = had
        for i, t in enumerate(texts):
            assert (bundles[i] == vector(t)).all(), t
        assert (every == sum(map(vector, texts))).all()


def test_tables_of_frequencies():
    for ids in ([], [7], [7] * 1000 + [49_999], list(range(5000)) * 2):
        t = rans.Table.of(np.array(ids, np.uint32))
        assert not len(ids) or (t.freq.sum() == 1 << t.bits and (t.freq > 0).all())


ODD = "doc_id long, text string, lang string, source string, n_removed int, kept_text string, `rest` string, `a.b` int, predicted int, score string, bucket string, n_words string"


def odd_documents(spark, n_chars: bool):
    """Repeated and null ids, null, empty, blank and long texts, equal rows, and columns with names that the operators use."""
    base = " ".join(f"word{i}" for i in range(60))
    texts = [base, base, base + " more", None, "", "  \n", "one", "x " * 20_000, base + " " + " ".join(f"other{i}" for i in range(40)), "12 34"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, base), (0, "another text of the same id"), (None, base), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "k", "r", 2, 3, "q", "b", "w") for i, t in rows], ODD)
    return df.selectExpr("*", "cast(length(text) as long) as n_chars") if n_chars else df


@pytest.mark.parametrize("n_chars", [True, False])
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, tmp_path, name, n_chars):
    spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs, stage = odd_documents(spark, n_chars), dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, f"file://{tmp_path}")
    rows = [r.asDict() for r in out.collect()]
    assert stage(spark, docs.limit(0), f"file://{tmp_path}").count() == 0
    if name == "packing":
        assert len({(r["doc_id"], r["doc_tokens"]) for r in rows}) >= 10 and sum(r["start"] == 0 for r in rows) == docs.count()
        return
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert all((r["a.b"], r["rest"], r["n_removed"], r["kept_text"], r["bucket"]) == (2, "r", 1, "k", "b") for r in rows)
    ids = sorted({r["doc_id"] for r in rows if r["doc_id"] is not None})
    if name == "quality_classifier":  # the base rate of 1/2 or so is above the threshold
        assert len(rows) == docs.count()
    if name == "language_id":
        assert ids == [0, 1, 2, 6, 7, 8] and sum(r["doc_id"] is None for r in rows) == 2
    if name == "ngram_jaccard":
        assert ids == [0, 3, 4, 5, 6, 7, 8, 9] and len(rows) == 12
    if name == "substring_dedup":
        by_id = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] not in (0, None)}
        assert by_id == {2: "more", 3: None, 4: "", 5: "  \n", 6: "one", 7: "x " * 20_000, 8: " ".join(f"other{i}" for i in range(40)), 9: "12 34"}
        assert [r["text"] for r in rows if r["doc_id"] is None] == [None] and sum(r["doc_id"] == 0 for r in rows) == 3
        assert not n_chars or all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
