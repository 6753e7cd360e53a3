"""Alignment against a brute force over the libraries' tokens, on ordinary and odd texts."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from convoke.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "  two  blanks ", "\n\nlines\n", "a <|endoftext|> b", "<s> <unk> </s> <0x41>", "▁ already ▁", "café naïve Ünïcode", "日本語のテキスト", "😀 emoji 👩‍👩‍👧", "\x00 nul \x01 mark", "tab\tand\r\nreturn",
       "x" * 3000, " " * 500, "é combining", " nbsp　wide", "1234567890 12.5%", "don't we'll they're", "�", "long " * 3000, "ab😀 " * 400]


def brute(rows: list[tuple]) -> Counter:
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    made, docs_of = [], Counter()
    for doc, text in rows:
        want = (" " + (text or "")).encode()
        one = a.encode(" " + text, add_special_tokens=False) if text else None
        ia, ib = (one.ids, b.encode(text)) if text else ([], [])
        ba = [bytes(letters[c] for c in t) for t in one.tokens] if text else []
        bb = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not text or b"".join(ba) != want or b"".join(bb) != want:
            made.append((doc, [], 0, 0))
            continue
        groups, x, y, i, j, ga, gb = [], 0, 0, 0, 0, [], []
        while i < len(ia) or j < len(ib):
            if x <= y:
                ga.append(ia[i])
                x, i = x + len(ba[i]), i + 1
            else:
                gb.append(ib[j])
                y, j = y + len(bb[j]), j + 1
            if x == y and ga and gb:
                groups.append((ga, gb))
                ga, gb = [], []
        made.append((doc, groups, len(ia), len(ib)))
        docs_of.update({(p, q) for g, h in groups for p in g for q in h})
    best = defaultdict(int)
    for (p, _), c in docs_of.items():
        best[p] = max(best[p], c)
    out = Counter()
    for doc, groups, na, nb in made:
        links = [(p, q) for g, h in groups for p in g for q in h]
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out[doc, na, nb, len(groups), len(links), sum(docs_of[x] == best[x[0]] for x in links), sum(docs_of[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""] += 1
    return out


def found(spark, rows, parts=3) -> Counter:
    df = spark.createDataFrame([(*r, "other", 1) for r in rows], "doc_id long, text string, part string, n_a int").repartition(parts)
    out = alignment.linked_counts(spark, df, A, B).collect()
    return Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in out)


def test_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("span,slice_,dense", [(1 << 18, 4_000_000, 4096), (50, 100, 2)])
def test_odd_texts(spark, monkeypatch, span, slice_, dense):
    """Nulls, repeated rows and ids, special tokens' strings, odd blanks; also in tiny blocks, so that groups and digests go on over many of them. Workers are forked with the constants that the driver has."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (3, "same"), (3, "same"), (5, None)]
    if span == 50:
        made = machine(rows, span, slice_, dense, monkeypatch)
        assert made == Counter({(k[0], *k[1:5], k[7]): n for k, n in brute(rows).items()})
    else:
        assert found(spark, rows) == brute(rows)


def machine(rows, span, slice_, dense, monkeypatch) -> Counter:
    """The events and the sweep in this process, with tiny blocks."""
    import pyarrow as pa

    for name, value in (("SPAN", span), ("SLICE", slice_), ("DENSE", dense)):
        monkeypatch.setattr(alignment, name, value)
    sides = (alignment.side(A), alignment.side(B))
    batch = []
    for i, (doc, text) in enumerate(rows):
        texts = pa.array([text or ""], pa.large_string())
        size = len((" " + (text or "")).encode())
        coded = [s.encode(texts) for s in sides]
        import numpy as np

        data = np.frombuffer((" " + (text or "")).encode(), np.uint8)
        good = np.array([size > 1])
        for s, (ids, counts) in zip(sides, coded, strict=True):
            good &= alignment.spelt_alike(s, ids, counts, data, np.array([size]))
        for b in alignment.packed([doc], i, good, [(s, ids, alignment.edges(counts)) for s, (ids, counts) in zip(sides, coded, strict=True)]):
            batch += list(zip(*(c.to_pylist() for c in b.columns), strict=True))
    batch.sort(key=lambda r: (r[0], r[2], r[3]))
    sweep, out, held, weight = alignment.Sweep(sides, 0, True), [], [], 0
    for r in batch:
        if weight > slice_ and (r[0], r[2]) != (held[-1][0], held[-1][2]):
            out += sweep.take(held, False)
            held, weight = [], 0
        held.append(r)
        weight += 2 * len(r[5])
    out += sweep.take(held, True)
    for r in out:
        assert [len(r[-2]), len(r[-1])] == [r[5], r[5]] and sum(map(len, r[-2])) == r[3] and sum(map(len, r[-1])) == r[4]
        assert sum(len(x) * len(y) for x, y in zip(r[-2], r[-1], strict=True)) == r[6] == int(r[9].sum())
    return Counter((r[2], r[3], r[4], r[5], r[6], r[7]) for r in out)


def test_empty_table_and_kept_groups(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    assert alignment.linked_counts(spark, df.limit(0), A, B).count() == 0
    kept = {r["doc_id"]: r for r in alignment.aligned(spark, df, A, B, keep=True).collect()}
    assert kept[2]["a"] == [] and kept[2]["n_groups"] == 0 and len(kept[1]["a"]) == len(kept[1]["b"]) == kept[1]["n_groups"] == 2
