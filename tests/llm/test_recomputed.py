"""Results made anew from the definitions, one value at a time: statistics of texts, fingerprints' vectors, languages; and rows that are odd for sentence pieces and vectors."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from convoke.llm import fingerprints, language, quality, transducer, vectors

TEXTS = ["", "   ", "One word.", "Hello, World! 12% of {it} | \"said\" don't!!\nA line\nA line\nanother  line (x)\n\nOK", "aa aa aa b", "é ünï\tcode ÀB\nÀB", "x" * 25 + " y", "end#\nend$ ~\n a b c", "1 22 333"]
MASK = (1 << 64) - 1


def statistics(text: str) -> list[float]:
    """The statistics in words: shares of bytes by kind, of words by form, and of what recurs."""
    raw = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    if not words:
        return [0.0] * len(quality.STATS)
    n, size = len(words), sum(map(len, words))
    upper, lower = set(range(65, 91)), set(range(97, 123)) | set(range(128, 256))
    symbol, bar, mark = set(b"#$%&*@^~=<>\\"), set(b"|{}[]"), set(b".,;:?'\"()-")
    count = lambda kind: sum(b in kind for w in words for b in w)
    often = Counter(words)
    core = raw.strip(b" \t\n\v\f\r")
    lines = core.count(b"\n") + 1
    own = [tuple(w for w in re.split(rb"[\x20\x09-\x0d]+", x) if w) for x in raw.split(b"\n")]
    own = [x for x in own if x]
    same = Counter(own)
    return [
        math.log1p(n), size / n, count(upper) / size, count(set(b"0123456789")) / size, count(symbol) / size, count({33}) / n, count(bar) / n, count(mark) / n, (count(upper) + count(lower)) / size,
        len(often) / n, max(often.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n, sum(w[-1] in symbol | {33} for w in words) / n, sum(w[0] in upper for w in words) / n,
        sum(len(w) <= 2 for w in words) / n, sum(len(w) >= 20 for w in words) / n, math.log1p(n / lines), sum(same[x] > 1 for x in own) / len(own),
    ]


def test_statistics():
    found = quality.statistics(pa.array([*TEXTS, None]))
    for t, row in zip([*TEXTS, ""], found, strict=True):
        assert row == pytest.approx(statistics(t)), t


def mix(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def summed(values: list[int]) -> int:
    """Of values at their places."""
    placed = [mix(mix(i + 0xD6E8FEB86659FD93 & MASK) + v & MASK) for i, v in enumerate(values)]
    return mix(sum(placed) + mix(len(values)) & MASK)


def run_of_three(a: int, b: int, c: int) -> int:
    join = lambda x, y: mix(x * 0x9E3779B97F4A7C15 + y & MASK)
    return mix(join(a, join(b, c)) + 3 & MASK)


def fingerprint(text: str) -> tuple[list[int], list[int], int]:
    exact, like = [0] * fingerprints.EXACT, [0] * fingerprints.LIKE
    for p in filter(None, (x.strip() for x in text.encode().split(b"\n"))):
        d = hashlib.blake2b(p, digest_size=64).digest()
        exact = [e + int.from_bytes(d[8 * i : 8 * i + 8], "little") & MASK for i, e in enumerate(exact)]
        words = [summed([mix(b + 1) for b in w]) for w in re.split(rb"[\x20\x09-\x0d]+", p) if w]
        runs = [run_of_three(*words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [summed(words)] if words else []
        for r in runs:
            like[r % fingerprints.LIKE] += 1 if r >> 63 else -1
    whole = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little") if text else 0
    return exact, [x % (1 << 32) for x in like], whole


def test_fingerprints_by_definition():
    texts = [*TEXTS, "a b c d\n\n a b c d \n", "one two three\nfour five six seven"]
    for t, f in zip(texts, fingerprints.fingerprints([t.encode() for t in texts]), strict=True):
        exact, like, whole = fingerprint(t)
        assert f.exact.tolist() == exact and f.whole == whole, t
        raw = base64.b64decode(f.text())
        assert raw == whole.to_bytes(8, "little") + b"".join(x.to_bytes(8, "little") for x in exact) + f.like.astype("<u4").tobytes()
        assert f.like.tolist() == like, t


def test_predictions(spark, sf_dir):
    """Languages and scores of all documents, from n-gram counts and letters' vectors."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    known: dict[str, np.ndarray] = {}

    def gram(g: str) -> np.ndarray:
        if g not in known:
            v = np.ones(language.DIM)
            for j, c in enumerate(reversed(g)):
                v = v * np.roll(language.letter_vectors(np.array([ord(c)]))[0], j)
            known[g] = v
        return known[g]

    def bundle(text):
        s = "".join(c if language.letters()[ord(c)] else " " for c in (text or "").lower())
        s = " " + "".join(w + " " for w in s.split())
        return sum((n * gram(g) for g, n in Counter(s[i : i + 3] for i in range(len(s) - 2)).items()), np.zeros(language.DIM))

    made, proto = [], defaultdict(lambda: np.zeros(language.DIM))
    for r in rows:
        held = zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        v = bundle(r["text"])
        made.append((r["doc_id"], held, v))
        if not held and r["lang"] is not None:
            proto[r["lang"]] += v
    names = sorted(proto)
    unit = {n: proto[n] / np.linalg.norm(proto[n]) for n in names}
    got = {r["doc_id"]: r for r in language.languages(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for doc, held, v in made:
        cos = [float(unit[n] @ v / np.linalg.norm(v)) if v.any() else 0.0 for n in names]
        best = max(range(len(names)), key=lambda k: cos[k])
        assert got[doc]["held_out"] == held and got[doc]["score"] == pytest.approx(min(1.0, max(0.0, cos[best])), abs=1e-4)
        near = sorted(cos)[-2:]
        if near[1] - near[0] > 1e-4:
            assert got[doc]["lang_pred"] == (names[best] if v.any() else language.UND)


def test_pieces_of_repeated_and_null_ids(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = [(1, "same"), (1, "same"), (1, "other"), (None, "no id"), (None, None), (2, ""), (3, "long  text " * 5000)]
    df = spark.createDataFrame([(*r, b"x", "y") for r in rows], "doc_id long, text string, ids binary, n_ids string").repartition(3)
    back = transducer.decoded(transducer.encoded(df, model), model)
    got = Counter((r["doc_id"], r["n_ids"], r["ids_crc32"], r["text"]) for r in back.collect())
    expected = Counter()
    for i, t in rows:
        ids = np.array(library.encode(t or ""), "<u4")
        expected[i, len(ids), zlib.crc32(ids.tobytes()), t or ""] += 1
    assert got == expected
    assert transducer.decoded(transducer.encoded(df.limit(0), model), model).count() == 0


def test_vectors_with_columns_of_the_same_names(spark):
    rows = [(1, [1.0, 0.0], 1, 9, 9, "k"), (2, [1.0, 0.0], 1, 9, 9, "k"), (3, [0.0, 1.0], 1, 9, 9, "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep long, copies int, k string")
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(spark, df).collect()} == {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)}
