"""Scores against a plain version, and context words that decide what is redacted."""

import random
import re

from cairn.llm import pii
from cairn.llm.queries import QUERIES


def plain_score(text, kind, a, b):
    words = lambda part: [w.lower() for w in re.findall(r"\w+", part)]
    starts = lambda part, given: any(w.startswith(g) for w in words(part) for g in given)
    before, after = text[max(0, a - 40) : a], text[b : b + 20]
    score = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.95}[kind]
    score += 0.3 * (starts(before, pii.CONTEXT[kind]) or starts(after, pii.CONTEXT[kind]))
    return min(1.0, round(score - 0.3 * starts(before, pii.AGAINST.get(kind, ())), 2))


def test_scores_equal_a_plain_version():
    rng = random.Random(9)
    parts = ["the", "Card:", "visa", "order", "ISBN", "call", "Phone", "version", "server", "ip", "mail", "bank", "x" * 30, "4111 1111 1111 1111", "+44 20 7946 0958", "10.0.0.7", "a@b.com", "DE89370400440532013000", "invoice no."]
    seen = set()
    for _ in range(2000):
        text = " - ".join(rng.choice(parts) for _ in range(rng.randint(1, 8)))
        for kind, a, b, score in pii.find(text):
            assert score == plain_score(text, kind, a, b), (text, kind)
            seen.add((kind, score))
    assert {("card", 0.4), ("card", 0.7), ("card", 1.0), ("ip", 0.3), ("phone", 0.3), ("phone", 0.9)} <= seen


def test_a_context_word_changes_a_redaction(spark):
    texts = ["pay with 4111 1111 1111 1111", "order 4111 1111 1111 1111", "order paid by card 4111 1111 1111 1111", "see 10.1.2.3", "version 10.1.2.3", "version 10.1.2.3 of the server"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(df, redacted=True).collect()}
    assert [got[i]["text"] for i in range(6)] == ["pay with [CARD]", texts[1], "order paid by card [CARD]", "see [IP]", texts[4], "version [IP] of the server"]
    assert all(len(got[i]["spans"]) == 1 for i in range(6))  # all are reported


def test_iban_needs_its_country_length():
    assert [x[0] for x in pii.find("GB82 WEST 1234 5698 7654 32, BE68 5390 0754 7034")] == ["iban", "iban"]
    good = "ZZ" + "00" + "1" * 16
    code = next(c for k in range(100) if pii.mod97(c := f"{good[:2]}{k:02d}{good[4:]}"))
    assert pii.find(code) == [] or all(x[0] != "iban" for x in pii.find(code))


def test_query_counts_what_is_acted_upon(spark, sf):
    rows = QUERIES["op3_personal_data"](spark, sf).collect()
    assert any(r["n_redacted"] for r in rows) and all(r["n_redacted"] <= r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_iban"] for r in rows)
