"""What hashes must not decide: words and runs of words that polynomial hashes take for equal, and collisions made on purpose."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convoke.llm import fingerprints, jaccard, quality, repeats
from convoke.llm import text as T
from tests.llm.test_operators import VOCABULARY, brute_components, sample, sets_of, words


def thue_morse(n: int) -> str:
    return "".join("ab"[k.bit_count() & 1] for k in range(1 << n))


ONE = thue_morse(12)
TWO = ONE.translate(str.maketrans("ab", "ba"))
SPACED = " ".join(ONE), " ".join(TWO)


def brute_repeats(rows):
    first, out = {}, {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


def removed(spark, rows, **options):
    out = repeats.remove_repeats(spark, spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3), **options).collect()
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out}


def test_words_and_runs_of_words_differ():
    w = T.words(pa.array([f"{ONE} {TWO}", *SPACED]))
    assert w.hash[0] != w.hash[1] and T.run_hashes(w.hash[2:], np.array([4096, 4096]))[0] != T.run_hashes(w.hash[2:], np.array([4096, 4096]))[1]
    same = T.words(pa.array([ONE, f"x {ONE}"])).hash
    assert same[0] == same[2] and T.word_numbers(w)[0] != T.word_numbers(w)[1]


def test_equal_hashes_of_different_words():
    number = np.array([0, 1, 2, 0, 1, 3, 0, 1, 2])
    group, n = T.exact_groups(np.full(3, 7, np.uint64), number, np.array([0, 3, 6]), 3)
    assert group[0] == group[2] != group[1] and group.max() < n
    assert T.exact_groups(np.zeros(0, np.uint64), number, np.zeros(0, np.int64), 3)[1] == 0


def test_repeats_of_like_words(spark):
    common = " ".join(VOCABULARY[:12])
    assert {i: n for i, (_, n, _) in removed(spark, [(0, f"{common} {ONE}"), (1, f"{common} {TWO}")]).items()} == {0: 0, 1: 0}
    assert removed(spark, [(0, f"{common} {ONE}"), (1, f"{common} {ONE}")])[1] == (13, 13, "")


@pytest.mark.parametrize("collide", [False, True])
def test_repeats_whatever_is_hot_or_cut(spark, monkeypatch, collide):
    """With every anchor hot, with tiny automata and streams, and with hashes that tell little."""
    rows = [*sample(5, 60), (1000, "x " * 3000), (1001, "x " * 2000 + "y"), (1002, "x " * 100 + "z " + "x " * 12)]
    expected = brute_repeats(rows)
    assert removed(spark, rows, hot=0) == expected
    ids = pa.array([r[0] for r in rows], pa.int64())
    texts = pa.array([r[1] for r in rows], pa.string())
    for name, value in {"WORDS": 200, "STREAM": 50, "CONFIRM": 300, "SLICE": 2000}.items():
        monkeypatch.setattr(repeats, name, value)
    if collide:
        monkeypatch.setattr(T, "sequence_hashes", lambda v, size: np.full(max(0, len(v) - size + 1), 6, np.uint64))
    # the steps in one process, for one chunk
    chunk = pa.scalar(0, pa.int64())
    docs = pa.table({"doc_id": ids, "text": texts, "chunk": pa.array([0] * len(rows), pa.int64())})
    sent = repeats.send_anchors(13, 6, 4)((chunk,), docs)
    answers = pa.concat_tables([repeats.answer_anchors(64)(sent.filter(pa.compute.equal(sent["bucket"], b))) for b in range(4) if b in sent["bucket"].to_pylist()])
    passages = repeats.send_passages(13, 6, 1)((chunk,), docs, answers)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))])
    out = repeats.remove(13, schema)((chunk,), docs, repeats.confirm(13)(passages)).to_pylist()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out} == expected


def test_jaccard_of_like_words(spark):
    rows = [(1, ONE), (2, TWO), (3, SPACED[0]), (4, SPACED[1]), (5, f"{ONE} p q r s"), (6, f"{TWO} p q r s"), (7, f"{ONE} P q r s")]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = sets_of(rows)
    assert out == {i: (len(sets[i]), r) for i, r in brute_components(sets).items()} and out[2][1] == 2 and out[7][1] == 5


def test_jaccard_verifies_words(monkeypatch):
    texts = [("a b c d e f g", "a b c d e f g"), ("a b c d e f g", "h i j k l m n"), ("a b", "A b"), ("a b", "b a"), ("a", "a b c d e f"), ("", ""), (None, "a")]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), *(pa.array([t[k] for t in texts]) for k in (0, 1))], names=["a", "b", "ta", "tb"])
    expected = [0, 2]
    assert [x for b in jaccard.verify(5, 75)(iter([batch])) for x in b.column(0).to_pylist()] == expected
    real = T.sequence_hashes
    monkeypatch.setattr(T, "sequence_hashes", lambda v, size: real(v * np.uint64(0) + np.arange(len(v), dtype=np.uint64) % 7, size))
    assert 1 not in [x for b in jaccard.verify(5, 75)(iter([batch])) for x in b.column(0).to_pylist()]


@pytest.mark.parametrize("backwards", [False, True])
def test_jaccard_of_one_id_in_any_order(spark, backwards):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(7, a), (7, b), (9, a + " z"), (11, b + " z")]
    df = spark.createDataFrame(rows[::-1] if backwards else rows, "doc_id long, text string").coalesce(1)
    out = sorted((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(spark, df).collect())
    assert out == [(7, 7), (7, 7), (9, 7), (11, 7)]


def test_fingerprints_of_like_words():
    for x, y in ((ONE, TWO), SPACED, (f"{ONE}\nrest", f"{TWO}\nrest")):
        a, b = fingerprints.fingerprints([x.encode(), y.encode()])
        assert not a.same_paragraphs(b) and (a.exact != b.exact).all() and a.likeness(b) < 1


def test_likeness_by_the_runs_themselves():
    """The cosine of the sums, taken apart: n-fold runs count n-fold, and texts without a common run are nearly orthogonal."""
    text = " ".join(VOCABULARY)
    a, twice, other = fingerprints.fingerprints([t.encode() for t in (text, f"{text}\n{text}", " ".join(f"{v}x" for v in VOCABULARY))])
    assert (twice.like == 2 * a.like).all() and a.likeness(twice) == pytest.approx(1) and a.likeness(other) < 0.4
    assert int(np.abs(a.like.view(np.int32)).sum()) <= len(VOCABULARY) - 2


@pytest.mark.parametrize("n", [0, 1, 2, 5, 19, 25])
def test_quality_of_few_or_constant_rows(spark, n):
    """Too few rows for a split, or none that tells labels apart: the base rate, for every text."""
    docs = spark.createDataFrame([(i, "the same words") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int")
    out = quality.quality_scores(spark, docs, labels).collect()
    assert len(out) == 40 and len({r["score"] for r in out}) == 1 and 0 <= out[0]["score"] <= 1
    x = np.zeros((n, len(quality.STATS)))
    y = np.arange(n) % 2
    model = quality.fit(x, y)
    assert not model.rules and (n < 2 or model.base == pytest.approx(np.log(y.mean() / (1 - y.mean()))))


@pytest.mark.parametrize(("sample", "extra"), [(10, 0), (10, 5000), (150, 0), (400, 100)])
def test_least_hashes_are_those_of_sorting_all(spark, sample, extra):
    """The share of hashes is widened where most labelled ids have no document; more rows than wanted, or fewer, are no matter."""
    stats = spark.range(300).selectExpr("id as doc_id", *[f"cast(id % {k + 2} as double) as {s}" for k, s in enumerate(quality.STATS)])
    known = spark.range(200).selectExpr("id as doc_id", "id % 2 as y").unionAll(spark.range(1000, 1000 + extra).selectExpr("id", "id % 2"))
    whole = stats.join(known, "doc_id").orderBy(F.xxhash64("doc_id")).limit(sample).select("y", *quality.STATS)
    assert quality.least_hashes(stats, known, sample).collect() == whole.collect()


@pytest.mark.parametrize("most", [0, 1, 100, 1000, 5000])
def test_most_frequent_tokens(spark, most):
    """About as many as there is room for, none of them less frequent than a step below one that is left out."""
    counted = spark.range(3000).selectExpr("id as token", "2 + cast(3000 / (1 + id) as long) as seen")
    kept = counted.where(jaccard.most_frequent(counted, most))
    seen, left = [r["seen"] for r in kept.collect()], [r["seen"] for r in counted.exceptAll(kept).collect()]
    assert abs(len(seen) - min(most, 3000)) <= 4 * most**0.5
    assert not seen or not left or min(seen) * 2 ** (1 / jaccard.STEPS) >= max(left) - 1


def test_blobs():
    import pyarrow as pa

    from convoke.llm import blobs

    rng = np.random.default_rng(1)
    for n in (0, 1, 500):
        t = pa.table({"t": rng.integers(0, 2**63, n).astype(np.uint64), "n": rng.integers(-5, 5, n), "flag": rng.random(n) < 0.5, "text": pa.array([b"x" * int(k) for k in rng.integers(0, 9, n)], pa.large_binary())})
        assert blobs.unpacked(blobs.pack(t)).equals(t)
        assert n != 1 or len(blobs.pack(t)) < 120
    a, b = (pa.table({"v": np.arange(k)}) for k in (3, 4))
    assert blobs.unpack(pa.chunked_array([pa.array([blobs.pack(a), blobs.pack(b)])]))["v"].to_pylist() == [0, 1, 2, 0, 1, 2, 3]


def test_unions_bound_what_opens(spark):
    """A query opens a group if the group's members have three quarters of its tokens between them, whichever of them."""
    from convoke.llm import jaccard
    from convoke.llm.scratch import Scratch

    words = [f"w{i}" for i in range(40)]
    texts = {1: words[:20], 2: words[16:40], 3: words[:40], 4: [*words[:30], *(f"z{i}" for i in range(10))], 5: [f"y{i}" for i in range(20)]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    grouped = spark.createDataFrame([(1, 10), (2, 10), (5, 11)], "rep long, grp long")
    opened = spark.createDataFrame([(q, len(texts[q]) - 4, g) for q in (3, 4) for g in (10, 11)], "q long, nq long, grp long")
    got = {tuple(r) for r in jaccard.qualifying(Scratch(spark, "unions"), opened, grouped, docs, 5, 75).collect()}
    whole = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    union = {10: whole(texts[1]) | whole(texts[2]), 11: whole(texts[5])}
    assert got == {(q, len(texts[q]) - 4, g) for q in (3, 4) for g in (10, 11) if 100 * len(whole(texts[q]) & union[g]) >= 75 * len(whole(texts[q]))} == {(3, 36, 10)}


def test_jaccard_sends_few_bytes_a_token():
    """Coded sets take less than 2 bytes a token (4 before), a bucket's rows less than 16, prefixes 6 where whole texts went; all come back as they were."""
    from types import SimpleNamespace

    from convoke.llm import jaccard

    rng = np.random.default_rng(5)
    for n in (0, 1, 900, 30000):
        s = np.unique(rng.integers(0, 1 << jaccard.COUNTED, n))
        blob = jaccard.coded(s)
        assert (jaccard.decoded(blob) == s).all() and len(blob) < 2 * len(s) + 40
    assert (jaccard.decoded(jaccard.coded(np.array([0, (1 << jaccard.COUNTED) - 1]))) == [0, (1 << jaccard.COUNTED) - 1]).all()

    docs, buckets = 1500, 32
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9999, 200)) for _ in range(docs)]
    ids = rng.permutation(docs) * 7 - 3000
    none = SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    (made,) = jaccard.prefixes(5, 75, none)(iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["doc_id", "text"])]))
    assert made["n"].to_pylist() == [196] * docs and {len(x) for x in made["prefix"].to_pylist()} == {6 * 50}
    big, linked = ids % 5 == 0, ids % 10 == 0
    info = {"grp": np.where(big, ids * 2**40 + 1, ids), "cluster": ids * 2**41 + 3, "csize": np.where(big, 9, 1), "linked": linked}
    batch = pa.RecordBatch.from_arrays([*made.columns, *(pa.array(x) for x in info.values())], names=[*made.schema.names, *info])
    blobs = [b for out in jaccard.prefix_tokens(buckets)(iter([batch])) for b in out["rows"].to_pylist()]
    assert len(blobs) == buckets and sum(map(len, blobs)) < 16 * 50 * docs
    got = [row for b in blobs for row in zip(*(x.tolist() for x in jaccard.bucket_rows(pa.chunked_array([pa.array([b])]))), strict=True)]
    of = dict(zip(ids.tolist(), zip(info["grp"].tolist(), np.where(linked, info["cluster"], 0).tolist(), info["csize"].tolist(), linked.tolist(), strict=True), strict=True))
    assert sorted((doc, left) for _, _, left, doc, *_ in got) == sorted((d, 196 - k) for d in ids.tolist() for k in range(50))
    assert all((n, *rest) == (196, *of[doc]) for _, n, _, doc, *rest in got)
