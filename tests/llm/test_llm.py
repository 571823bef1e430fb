"""Every operator against a brute-force version on small inputs, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import ann, bayes_quality, bpe, components, langid, mixing, neardup, pii, quality_rules, site_tree, token_files
from cairn.llm.queries import QUERIES, vocabulary
from cairn.llm.words import Words

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, lang="en", source="s", start=0):
    return spark.createDataFrame([(start + i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], DOC)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def noisy_texts(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(n // 4)]
    out = []
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 20])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(rng.choice([" ", "  ", "\t"]).join(words) + rng.choice(["", "\n", " "]))
    return out + ["", None, " \t\n", "one", "one two", "One  TWO", "one two three", "x " * 3000]


def shingle_set(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, n, percent):
    texts = noisy_texts(160)
    sets = [shingle_set(t, n) for t in texts]
    up = list(range(len(texts)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    want = [(i, len(sets[i]), root(i), root(i) == i) for i in range(len(texts))]
    df = documents(spark, texts).withColumn("value", F.lit(1)).withColumn("low", F.lit(1))
    assert rows(neardup.near_duplicates(df, n, percent)) == sorted(want, key=str)


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (0, "A B c d e f"), (5, None)], "doc_id long, text string")
    assert rows(neardup.near_duplicates(df, 3, 85)) == sorted([(1, 4, 0, False), (1, 4, 0, False), (None, 4, None, True), (0, 4, 0, True), (5, 0, 5, True)], key=str)
    assert neardup.near_duplicates(df.limit(0), 3, 85).count() == 0


def test_near_copies_in_blocks_of_a_large_list(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(90):
        words = list(base)
        for _ in range(rng.randint(1, 8)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [shingle_set(t, 3) for t in texts]
    edges = [(i, j) for i in range(90) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    up = list(range(90))
    root = lambda i: i if up[i] == i else root(up[i])
    for i, j in edges:
        a, b = sorted((root(i), root(j)))
        up[b] = a
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents(spark, texts), 3, 85).collect()}
    assert got == {i: root(i) for i in range(90)}


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, 99), (3, 3), (7, 99), (None, 4)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 10 for i in range(10, 61)} | dict.fromkeys((100, 99, 7), 7)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2]) == 0 % 10 or (13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_base_spans_equal_the_patterns():
    rng = random.Random(11)
    parts = ["a", "b.c", "@", "@x.y", "..", "-", " ", "1", "12", "255", "256", ".", "+4", "+1 (23)", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", "%+", "\n", "0", "(", ")", "a@b.c.d", "1.2.3.4", "00000000000000000000"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        got = [x[:3] for x in pii.find(text) if x[0] != "iban"]
        assert got == base_spans(text), text


def test_pii_iban_context_redaction_and_long_texts(spark):
    text = "IBAN DE89370400440532013000 THE card 4111 1111 1111 1111, mail a@b.com"
    found = pii.find(text)
    assert [x[0] for x in found] == ["email", "card", "iban"] and found[1][3] == 1.0
    assert pii.redact(text, found, 0.5) == "IBAN [IBAN] THE card [CARD], mail [EMAIL]"
    assert pii.find("7" * 300_000 + "@" * 50_000 + "a" * 300_000) == []
    df = spark.createDataFrame([(1, text, 5), (None, None, 5), (2, "", 5)], "doc_id long, text string, spans int")
    assert [len(r["spans"]) for r in pii.find_pii(df).orderBy("doc_id").collect()] == [0, 3, 0]
    assert pii.find_pii(df.limit(0)).count() == 0


def test_pii_addresses_with_many_zeros():
    zeros = "0" * 5000
    assert [x[:3] for x in pii.find(f"{zeros}.1.2.3") if x[0] == "ip"] == [("ip", 0, 5006)]
    assert [x[0] for x in pii.find(f"1.2.{zeros}255.3 and 1.2.{zeros}256.3")] == ["ip"]


def test_quality_counts_equal_brute_force(spark):
    texts = noisy_texts(60, 9) + ["a b c a b c a\na b c\n\na b c\n a b c\n", "# $ %\n# $ %", "É é #*"]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(documents(spark, texts), spark.createDataFrame([], "doc_id long, quality int")).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        repeats = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)} if len(windows) < 500 else set(range(len(words)))
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeats))
        failed = len(words) < 50 or 100 * len(repeats) > 50 * len(words)
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == want
        assert got[i]["base_failed"] == failed and got[i]["kept"] == (not failed)


def test_binomial_bounds_and_cutoffs(spark):
    exact = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n, p in [(0, 10, 0.1), (3, 50, 0.2), (7, 8, 0.9)]:
        assert math.isclose(math.exp(quality_rules.log_binomial_cdf(k, n, p)), exact(k, n, p), rel_tol=1e-9)
    assert quality_rules.within_risk(0, 100, 0.05, 0.01) and not quality_rules.within_risk(0, 50, 0.05, 0.01) and not quality_rules.within_risk(0, 0, 0.5, 0.5)
    good = ["w%d " % i + " ".join(f"q{j}x{i}" for j in range(60)) for i in range(6000)]
    bad = ["# " * 200 + str(i) for i in range(3)]
    df = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 6000)) for i in range(6003)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(df, labels).collect()}
    assert all(out[i]["kept"] for i in range(6000)) and all("symbols" in out[i]["rejected_by"] for i in range(6000, 6003))


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    parts = ["a", "th", "er", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "漢字", "1", "23", "!", "---", "'s", "'ll", "<|endoftext|>", "<|end", "😀", "́", "Σ", "z" * 50, " " * 60, "\U00011de1", "\U00012480"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(3000)] + ["qx" * 20_000]
    got = bpe.encode_decode(documents(spark, [*texts, None]), path).orderBy("doc_id").collect()
    for t, r in zip([*texts, ""], got, strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_decode(documents(spark, ["a"]).limit(0), path).count() == 0


def test_bpe_pair_check_agrees_with_merging():
    t = bpe.tokenizer(vocabulary("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50_000, 5000), rng.integers(0, 50_000, 5000)
    merged = t.merged([t.bytes[x] + t.bytes[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    assert t.compatible(a, b).tolist() == [m == [x, y] for m, x, y in zip(merged, a.tolist(), b.tolist(), strict=True)]


def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    parts = ["The", "the", "qué", "x1", " ", "\n", "\t", ".", ",", "'s", "é", "!?", "　", "<|endoftext|>", "ΑΣ", "漢", "can't", "A,", "3.", "\x1c", "Æ."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(1500)] + [None, ""]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, texts[i], "x") for i in ids], "doc_id long, text string, part string").repartition(5)
    parts_ = token_files.write_token_files(df, path, end_id=2, parts=7)
    got = token_files.read_token_files(spark, parts_).orderBy("doc_id").collect()
    at = 0
    for i, r in enumerate(got):
        want = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (i, at, len(want), zlib.crc32(want.tobytes())), texts[i]
        at += len(want)
    assert len(got) == len(texts)
    assert token_files.read_token_files(spark, token_files.write_token_files(df.limit(0), path)).count() == 0
    two = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    assert [r["doc_id"] for r in token_files.read_token_files(spark, token_files.write_token_files(two, path, parts=2)).orderBy("start").collect()] == [None, 1, 1]


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    v[50:120] = v[7]
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (None, [1.0] * 8), (3, v[3].tolist()), (950, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("q", F.lit(0)).repartition(6)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    x = v.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    for q in range(0, 400, 50):
        s = np.clip((x * x[q]).sum(1) / (norm * norm[q]), -1, 1)
        want = sorted((j for j in range(400) if j != q), key=lambda j: (-s[j], j))[:5]
        assert [j for j, _ in got[q]] == want and np.allclose([y for _, y in got[q]], s[want], atol=1e-15)
    assert len(got) == 8
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(few, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 1, 0.0)]
    assert ann.nearest(few.limit(0), F.col("vec_id") == 0, 5).count() == 0


def test_nearest_of_mixed_lengths(spark):
    """Odd rows at the head of a block: vectors of equal length still meet, those of different lengths do not."""
    rng = np.random.default_rng(8)
    v = {i: rng.normal(size=3 if i in (0, 7, 8, 20) else 5) for i in range(40)}
    data = [(100, [0.0] * 4), (101, [float("nan")] * 2), *((i, x.tolist()) for i, x in v.items())]
    got = {}
    for r in ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") % 10 == 0, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    assert got == {q: sorted((j for j in v if j != q and len(v[j]) == len(v[q])), key=lambda j: -cosine(v[q], v[j]))[:4] for q in (0, 10, 20, 30)}


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    import itertools

    e, steps = rng.random((5, 3)).astype(np.float64), rng.random((3, 3)) + 0.1
    want = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        p = steps[:, path[0]].mean() * e[0, path[0]]
        for t in range(1, 5):
            p *= steps[path[t - 1], path[t]] * e[t, path[t]]
        for t, k in enumerate(path):
            want[t, k] += p
    assert np.allclose(langid.marginals(e, np.array([0, 0, 5, 5]), steps), want / want.sum(1, keepdims=True))
    long = rng.random((1000, 3))
    first = np.array([0, 700, 700, 1000])
    by_one = [langid.backward(long[None, a:b], np.ones((1, b - a), bool), steps, np.full((1, 3), 1 / 3))[0] * langid.forward(long[None, a:b], np.ones((1, b - a), bool), steps, np.full((1, 3), 1 / 3))[0] for a, b in ((0, 700), (700, 1000))]
    by_one = np.concatenate(by_one)
    assert np.allclose(langid.marginals(long, first, steps), by_one / by_one.sum(1, keepdims=True))


def test_language_held_out_accuracy_and_edges(spark, sf):
    out = QUERIES["op1_language"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = out.join(docs, "doc_id").filter("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok")).agg(F.avg("ok"), F.count("*")).first()
    assert held[0] > 0.97 and held[1] > 20
    model = langid.train([("en", "the house and the tree with the green leaves " * 6), ("de", "das haus und der baum mit den grünen blättern " * 6)])
    df = spark.createDataFrame([(1, None), (2, "12 34"), (None, "the tree the house"), (3, "der baum und das haus"), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model).collect()}
    assert got == {1: "und", 2: "und", None: "en", 3: "de", 4: "und"}
    words = langid.label_words(spark.createDataFrame([(1, "the green tree and the house und der baum mit den blättern 12")], "doc_id long, text string"), model).first()["words"]
    assert [w["lang"] for w in words][:6] == ["en"] * 6 and [w["lang"] for w in words][-6:] == ["de"] * 5 + ["und"]
    empty = langid.train(langid.training_samples(df.withColumn("lang", F.lit(None).cast("string"))))
    assert {r["lang_pred"] for r in langid.identify(df, empty).collect()} == {"und"} and langid.identify(df.limit(0), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<div class="box">Same words everywhere</div>%s<div id="comments"><p>First!</p></div><form><p>Mail <input></p></form><aside>side</aside><footer>&copy; x %d</footer></body></html>"""


def test_main_text(spark):
    article = "<article><h1>Title &amp; more %d</h1><p><b>One\n  two<br>three &lt;b&gt; %d<p>Next &eacute;</p><ul><li>a<li>b %d</ul></article>"
    pages = [(i, f"http://h.example.com/{i}", PAGE % (article % (i, i, i), i)) for i in range(12)]
    plain = "<div class='content'><p>Body %d of the page</p><p>More %d</p></div>"
    pages += [(100 + i, f"http://g.example.com/{i}", PAGE % (plain % (i, i * 7), i)) for i in range(12)]
    pages += [(200, None, None), (201, "http://h.example.com/q", ""), (202, "::bad::[", "<p>x"), (None, "http://h.example.com/z", "just text < 5 & so <p"), (203, None, PAGE % ("", 1)[:0] if False else "<article>" + "a " * 200_000 + "</article>")]
    got = {r["page_id"]: r for r in site_tree.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("x"))).collect()}
    for i in range(12):
        assert got[i]["text"] == f"Title & more {i}\nOne two three <b> {i}\nNext é\na\nb {i}"
        assert got[100 + i]["text"] == f"Body {i} of the page\nMore {i * 7}"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[200]["text"] == "" and got[201]["text"] == "" and got[202]["text"] == "x" and got[None]["text"] == "just text < 5 & so"
    assert got[203]["n_chars"] == 399_999
    assert site_tree.extract(spark.createDataFrame(pages[:1], "page_id long, url string, html string").limit(0)).count() == 0


def test_main_text_with_many_keys(spark, monkeypatch):
    plain = "<div class='content'><p>Body %d of the page</p></div>"
    df = spark.createDataFrame([(i, f"http://G.example.com/{i}", PAGE % (plain % i, i)) for i in range(12)], "page_id long, url string, html string")
    want = rows(site_tree.extract(df))
    monkeypatch.setattr(site_tree, "MOST_SENT", 0)
    assert rows(site_tree.extract(df)) == want


def test_main_text_of_bad_urls_with_many_keys(spark, monkeypatch):
    """URLs that do not parse, null and repeated pages have the same text whatever the number of keys, and hosts are read the same way."""
    plain = "<div class='content'><p>Body %d of the page</p></div>"
    urls = ["http://G.example.com/a b|c", "http://g.example.com/[", "http://u:p@g.example.com:80/", "http://[::1", "::bad::[", "http://a b/", "//g.example.com/x", None]
    pages = [(i, urls[i % 8], PAGE % (plain % i, i)) for i in range(48)] + [(3, urls[0], None), (4, urls[0], ""), (5, urls[5], PAGE % (plain % 5, 5)), (5, urls[5], PAGE % (plain % 5, 5)), (None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = rows(site_tree.extract(df))
    assert len(want) == len(pages) and any(r[2] == "Body 0 of the page" for r in want)
    monkeypatch.setattr(site_tree, "MOST_SENT", 0)
    assert rows(site_tree.extract(df)) == want


def test_main_text_at_any_depth():
    deep = "<article><p>One</p>" + "<div>" * 300 + "<p>Deep</p><nav>Menu</nav>" + "</div>" * 300 + "<p>After</p></article><div>Outside</div>"
    assert site_tree.main_text(deep, "", frozenset()) == "One\nDeep\nAfter"
    fonts = "<main><div>" + "<font>" * 50_000 + "<div>x<b>" * 500 + "</i>" * 50_000 + "</div>" * 500 + "</div><p>Last</p></main><p>Outside</p>"
    assert site_tree.main_text(fonts, "", frozenset()) == "\n".join(["x"] * 500 + ["Last"])
    icons = '<article><p>One <svg class="i"/>two <math/>three</p><p>Let <math><mi>a</mi><mspace/><mo>=</mo><mn>1</mn><annotation>a=1</annotation></math> be</p><svg><text>icon</text></svg><p>Last</p></article>'
    assert site_tree.main_text(icons, "", frozenset()) == "One two three\nLet a=1 be\nLast"
    paths = {x[0] for x in site_tree.page_nodes('<div class="a b c d e">1</div><div class="a b c d f">2</div>') if not x[5]}
    assert len(paths) == 3
    one, two = (site_tree.page_nodes(f"<div><p>a</p></div><div><p>{x}</p><p>c</p></div>") for x in "bd")
    assert [x[0] for x in one] == [x[0] for x in two] and [x[5] for x in one] != [y[5] for y in two]


def test_main_text_keeps_branches_that_differ_whatever_their_names(spark):
    names = """<div class="content-with-sidebar"><article class="post has-share"><h2 id="related-work">Related work %d</h2><section id="form-of-government"><p>Form %d</p></section>
    <div class="notice"><p>Notice %d</p></div><div class="share"><p>Share this</p></div></article></div><div class="sidebar"><article><p>Teaser %d</p></article></div>"""
    plain = '<div class="text"><p>Body %d</p></div><div class="social-history"><p>History %d</p></div><div class="social"><p>Follow us</p></div><div id="cookie-notice"><p>We use cookies</p></div>'
    pages = [(i, f"http://h.example.com/{i}", PAGE % (names % (i, i, i, i), i)) for i in range(12)]
    pages += [(100 + i, f"http://g.example.com/{i}", PAGE % (plain % (i, i), i)) for i in range(12)]
    pages += [(200, "http://one.example.com/", names % (1, 1, 1, 1)), (201, "http://two.example.com/", '<div class="widget-page"><article><p>Only one</p><div class="share">Share</div></article></div>')]
    pages += [(300 + i, "http://rare.example.com/", PAGE % ('<div class="text"><p>Body %d</p>%s</div>' % (i, '<div class="related-work">Once</div>' if i == 5 else ""), i)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in site_tree.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"Related work {i}\nForm {i}\nNotice {i}"
        assert got[100 + i] == f"Body {i}\nHistory {i}"
        assert got[300 + i] == f"Body {i}" + "\nOnce" * (i == 5)
    assert got[200] == "Related work 1\nForm 1" and got[201] == "Only one"


def test_classifier(spark):
    rng = random.Random(1)
    texts, sources, labels = [], [], []
    for i in range(300):
        good = rng.random() < (0.9 if i % 3 else 0.3)
        texts.append(" ".join(rng.choice(["clear", "plain", "text"] if good else ["spam", "win", "cash"]) if rng.random() < 0.3 else f"w{rng.randrange(50)}" for _ in range(40)))
        sources.append("a" if i % 3 else "b")
        labels.append((i, int(good)))
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], DOC)
    lab = spark.createDataFrame(labels[:240] + [(None, 1), (5, None), (7, 0), (7, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in bayes_quality.score(df, lab).collect()}
    assert sum((out[i]["probability"] > 0.5) == bool(y) for i, y in labels[240:]) > 50
    assert out[241]["path_rate"] != out[240]["path_rate"] and 0 < out[250]["host_rate"] < 1
    none = bayes_quality.score(df.withColumn("text", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")), lab.limit(0)).collect()
    assert len(none) == 300 and all(r["path_rate"] == 0.5 for r in none)
    assert bayes_quality.score(df.limit(0), lab).count() == 0


def test_raking_meets_the_targets(spark):
    rng = random.Random(3)
    cells = [(s, lang, t, rng.randint(1, 500)) for s in "abcdef" for lang in ("en", "de", "") for t in range(4)]
    df = spark.createDataFrame(cells, "source string, lang string, topic int, tokens long")
    fit = mixing.rake(df, 0.3, 0.5, languages={"en": 0.5, "de": 0.3, "": 0.2}, close=1e-6)
    factor, all_tokens = {r["source"]: r["factor"] for r in fit.sources.collect()}, sum(c[3] for c in cells)
    weight = {(s, lang, t): n * factor[s] * fit.languages[lang] * fit.topics[t] / (0.3 * all_tokens) for s, lang, t, n in cells}
    share = lambda k, v: sum(w for key, w in weight.items() if key[k] == v)
    assert math.isclose(share(1, "en"), 0.5, abs_tol=1e-5) and math.isclose(share(1, ""), 0.2, abs_tol=1e-5)
    root = {s: math.sqrt(sum(n for a, _, _, n in cells if a == s)) for s in "abcdef"}
    for s in root:
        assert math.isclose(share(0, s), root[s] / sum(root.values()), abs_tol=1e-5)


def test_mixing_sample(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix(docs, 0.5)
    r = out.agg(F.sum(F.col("n_tokens") * F.col("probability")), F.sum("n_tokens"), F.avg((F.col("probability") > 0).cast("int")), F.count("*")).first()
    assert abs(r[0] / r[1] - 0.5) < 0.005 and r[2] == 1.0 and r[3] == docs.count()
    edge = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word words", None, "s", 0), (2, "word words", None, "s", 0)], DOC)
    assert mixing.mix(edge).count() == 4 and mixing.mix(edge.limit(0)).count() == 0 and mixing.mix(edge.filter("doc_id = 1")).first()["sampled"] is False


def test_pipeline_stages_against_brute_force(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = p.language_id(spark, docs, sf).cache()
    assert one.columns == docs.columns and one.count() > 0.95 * docs.filter("text IS NOT NULL").count()
    two = p.near_duplicates(spark, one, sf).cache()
    kept = {r["doc_id"] for r in two.collect()}
    sets = {r["doc_id"]: shingle_set(r["text"], 5) for r in one.collect()}
    for i, a in sets.items():
        if i not in kept:
            assert any(j < i and len(a & b) >= 0.8 * len(a | b) for j, b in sets.items()) or any(100 * len(a & b) >= 80 * len(a | b) for j, b in sets.items() if j != i)
    for i in kept:
        assert not any(j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in kept)
    three = p.personal_data(spark, two, sf).cache()
    assert three.columns == docs.columns and not any(pii.find(r["text"] or "") and [x for x in pii.find(r["text"]) if x[3] >= 0.5] for r in three.collect())
    four = p.mixing_weights(spark, three, sf).cache()
    assert 0 < four.count() < three.count()
    five = p.bpe_tokens(spark, four, sf).collect()
    assert len(five) == four.count() and all(r["round_trip"] for r in five)
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf).count() == 0
    nulls = spark.createDataFrame([(None,) * 5, (1, "", None, None, None), (1, "", None, None, None)], DOC)
    for _, stage in p.STAGES:
        stage(spark, nulls, sf).collect()


def test_pipeline_keeps_switching_texts_and_null_ids(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text IS NOT NULL")
    by = {}
    for r in docs.orderBy("doc_id").collect():
        by.setdefault(r["lang"], []).extend(r["text"].split()[:60])
    words = [w for w in list(by.values()) if len(w) > 300]
    assert len(words) >= 3
    switching = " ".join(" ".join(w[i * 25 : i * 25 + 25]) for i in range(12) for w in words)
    added = spark.createDataFrame([(10**9, switching, None, "s", len(switching)), (10**9 + 1, "12 34", None, "s", 5)], DOC)
    kept = {r["doc_id"]: r for r in p.language_id(spark, docs.select(*p.COLUMNS).unionByName(added), sf).filter(F.col("doc_id") >= 10**9).collect()}
    assert list(kept) == [10**9] and kept[10**9]["text"] == switching
    nameless = docs.select(*p.COLUMNS).withColumn("doc_id", F.lit(None).cast("long"))
    drawn = p.mixing_weights(spark, nameless, sf)
    share = drawn.count() / nameless.count()
    assert drawn.columns == list(p.COLUMNS) and 0.2 < share < 0.9 and drawn.exceptAll(nameless).count() == 0
    named = p.mixing_weights(spark, docs, sf)
    sampled = mixing.mix(docs, p.FRACTION).filter("sampled").select("doc_id")
    assert rows(named.select("doc_id")) == rows(sampled) and named.exceptAll(docs.select(*p.COLUMNS)).count() == 0


def test_digest_columns(spark, sf):
    r = QUERIES["op3_personal_data"](spark, sf).filter("n_email > 0").first()
    base = [x for x in r["spans"].split(",") if not x.startswith("iban")]
    assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
    r = QUERIES["op10_bpe_round_trip"](spark, sf).orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").first()["text"]
    assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_words():
    w = Words(pa.array(["a b", None, "", " x y\x0bz ", "A"]), lower=True)
    assert w.counts.tolist() == [2, 0, 0, 2, 1]


def test_carried_columns_and_clashing_names(spark):
    from cairn.llm.shared import carried

    df = spark.createDataFrame([(1, "a b", "old", 2.5), (2, None, None, None)], "doc_id long, text string, words string, extra double")
    out = carried(df, lambda text: [pa.array([len((t or "").split()) for t in text.to_pylist()], pa.int64())], {"words": "long"})
    assert out.columns == ["doc_id", "text", "extra", "words"] and rows(out) == sorted([(1, "a b", 2.5, 2), (2, None, None, 0)], key=str)
    out = carried(df.select("doc_id", "text"), lambda text: [pa.array(["x"] * len(text))], {"text": "string"})
    assert [r["text"] for r in out.collect()] == ["x", "x"]


def test_large_equal_groups_keep_every_row(spark):
    """A third of all rows are one text, another third one near copy each: nothing is lost and no pair is made twice."""
    base = [f"word{i}" for i in range(80)]
    texts = [" ".join(base)] * 300 + [" ".join([*base[:40], f"new{i}", *base[41:]]) for i in range(300)] + [f"other {i} text {i * 7} here {i}" for i in range(300)]
    got = {r["doc_id"]: r for r in neardup.near_duplicates(documents(spark, texts), 3, 85).collect()}
    assert len(got) == 900 and all(got[i]["component_id"] == 0 for i in range(600)) and all(got[i]["component_id"] == i for i in range(600, 900))
    assert sum(r["kept"] for r in got.values()) == 301
