"""Odd rows in every stage of the pipeline and in the operators on pairs: extra columns of clashing names, several texts of one doc_id, nulls in any column."""

import math

from cairn.llm import bpe, langid, mixing, neardup, pii
from cairn.llm.queries import vocabulary


def test_stages_with_extra_columns_of_clashing_names(spark, sf):
    import corpus_pipeline as p

    text = "the house and the tree with the green leaves on the hill by the sea " * 8
    rows = [(i, f"{text} number{i} a@b.com" if i % 4 else None, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, 5) for i in range(24)] + [(None, text, None, None, None)]
    clash = ("lang_pred", "lang_evidence", "component_id", "kept", "topic", "factor", "weight", "sampled", "ids", "round_trip", "_doc_text", "mark")
    docs = spark.createDataFrame([(*r, *(["x"] * len(clash))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == list(p.COLUMNS), name
        assert {r["doc_id"] for r in out.collect()} <= {r[0] for r in rows}
    last = p.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == len(rows) and all(r["round_trip"] for r in last if r["n_tokens"])
    assert len([r for r in p.near_duplicates(spark, docs, sf).collect() if r["doc_id"] is None]) == 1
    kept = p.language_id(spark, docs, sf).collect()
    assert all(r["text"] for r in kept) and any(r["doc_id"] is None for r in kept)


def test_several_texts_of_one_doc_id(spark):
    """The smallest text of a doc_id decides its links, in any order and dealing of the rows; every row comes back with its own size."""
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join([*words[:30], "x", *words[31:]])
    rows = [(1, a), (1, f"zz {a[::-1]}"), (2, b), (3, a), (2, b)]
    want = None
    for order in (rows, rows[::-1]):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3), 3, 85).collect())
        want = want or got
        assert got == want and len(got) == 5
    assert {c for i, n, c in want if i == 3} == {1}


def test_operators_over_all_nulls(spark):
    docs = spark.createDataFrame([(None,) * 4] * 3, "doc_id long, text string, lang string, source string")
    assert [tuple(r) for r in langid.identify(docs, langid.train([])).collect()] == [(None, "und", 0.0)] * 3
    assert all(r["spans"] == [] for r in pii.find_pii(docs).collect())
    assert all(r["ids"] == [] for r in bpe.encode_decode(docs, vocabulary("byte_bpe_50k.json")).collect())
    out = mixing.mix(docs).collect()
    assert len(out) == 3 and all(r["topic"] == -1 and r["sampled"] is False and not math.isnan(r["probability"]) for r in out)
    assert [tuple(r) for r in neardup.near_duplicates(docs, 3, 85).collect()] == [(None, 0, None, True)] * 3


def test_texts_of_one_doc_id_all_stay(spark, sf):
    """Of a kept doc_id every different text stays, and each once."""
    import corpus_pipeline as p

    texts = [(1, "one two three four five six seven"), (1, "other words of the same number here now"), (1, "one two three four five six seven"), (1, None), (2, "one two three four five six seven"), (None, "no number"), (None, "no number")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    for n in (1, 3):
        got = sorted(((r["doc_id"], r["text"]) for r in p.near_duplicates(spark, docs.repartition(n), sf).collect()), key=str)
        assert [x for x in got if x[0] is None] == [(None, "no number")] * 2
        assert {x for x in got if x[0] == 1} == {x for x in texts if x[0] == 1} and sum(x[0] == 1 for x in got) == 3
