"""The pipeline's stages one after another, each written and read again, on a small table with planted cases."""

import random

import corpus_pipeline
from convoke.llm import queries
from tests.llm.test_operators import brute_components, sets_of


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        stage(spark, docs, d).write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        after = docs.toPandas()
        if name == "packing":
            assert set(after["doc_id"]) == set(before["doc_id"])
            continue
        assert list(after.columns) == columns and set(after["doc_id"]) <= set(before["doc_id"])
        if name == "ngram_jaccard":
            root = brute_components(sets_of(list(zip(before["doc_id"], before["text"], strict=True))))
            assert set(after["doc_id"]) == {i for i, r in root.items() if i == r}
        if name == "substring_dedup":
            assert (after["n_chars"] == after["text"].str.len()).all()
    assert corpus_pipeline.run(spark, d).count() == len(after)


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES if q.startswith("op")) == list(range(1, 14))


FOREIGN = {
    "italian": "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita quanto a dir qual era e cosa dura questa selva selvaggia e aspra e forte che nel pensier rinova la paura tanto e amara che poco e piu morte ma per trattar del ben che vi trovai diro de l altre cose che vi ho scorte",
    "polish": "litwo ojczyzno moja ty jestes jak zdrowie ile cie trzeba cenic ten tylko sie dowie kto cie stracil dzis pieknosc twa w calej ozdobie widze i opisuje bo tesknie po tobie panno swieta co jasnej bronisz czestochowy i w ostrej swiecisz bramie ty co grod zamkowy nowogrodzki ochraniasz z jego wiernym ludem",
    "finnish": "mieleni minun tekevi aivoni ajattelevi lahteani laulamahan saanani sanelemahan sukuvirtta suoltamahan lajivirtta laulamahan sanat suussani sulavat puhe et putoelevat kielelleni kerkiavat hampahilleni hajoovat veli kulta veikkoseni kaunis kasvinkumppalini lahe nyt kanssa laulamahan saa kera sanelemahan",
    "russian": "мой дядя самых честных правил когда не в шутку занемог он уважать себя заставил и лучше выдумать не мог его пример другим наука но боже мой какая скука с больным сидеть и день и ночь не отходя ни шагу прочь",
}


def test_language_id_rejects(spark):
    """Languages never learnt, another script and random letters go at each length from 150 characters on, also with a wrong label; all texts of the table stay."""
    rng = random.Random(9)
    foreign = [t[:n] for t in FOREIGN.values() for n in (150, 199, 300)] + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=n)) for n in (100, 199, 1000, 5000, 20000)]
    rows = [(10**6 + i, t, "en" if i % 5 == 0 else None, "x", len(t)) for i, t in enumerate([*foreign, "1234 5678"])]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    genuine = {r["doc_id"] for r in docs.where("regexp_like(text, '[a-zA-Z]')").select("doc_id").collect()}
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(docs.columns)
    left = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(more), "").select("doc_id").collect()}
    assert genuine <= left and not {i for i in left if i >= 10**6}


def test_language_id_odd_rows(spark):
    """With too few labelled texts to tell nothing goes but what has no letter."""
    docs = spark.createDataFrame([(1, "one two three", "en"), (2, "xqz", None), (3, "12", "en"), (None, "one", "en"), (4, None, None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {1, 2, None}
    assert corpus_pipeline.language_id(spark, docs.limit(0), "").count() == 0
