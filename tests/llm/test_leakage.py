import random

from hypothesis import given, settings
from hypothesis import strategies as st

from talkloom.llm import leakage as L

RNG = random.Random(8)
VOCAB = [f"w{i}" for i in range(400)]
ITEM = [" ".join(RNG.choice(VOCAB) for _ in range(40)) for _ in range(5)]
JA = "".join(chr(0x4E00 + RNG.randrange(3000)) for _ in range(80))


def runs(es, text):
    return {item: n for _, item, n in es.matches([text])}


def brute(doc, item, cut, n):
    a, b = cut(doc), cut(item)
    own = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    return any(tuple(a[i : i + n]) in own for i in range(len(a) - n + 1))


def test_spans():
    es = L.EvalSet([(i, "en", t) for i, t in enumerate(ITEM)] + [(9, "ja", JA), (10, "en", None), (11, "en", "too short")])
    w = ITEM[0].split()
    assert runs(es, "x " + " ".join(w[5:17]) + " y") == {0: 12}
    assert runs(es, "x " + " ".join(w[5:16]) + " y") == {}
    assert runs(es, " ".join(w[5:17]).upper().replace(" ", "**, \n> ")) == {0: 12}
    assert runs(es, "".join(chr(ord(c) + 0xFEE0) if c != " " else "　" for c in " ".join(w[:14]))) == {0: 14}
    assert runs(es, "-".join(w[:12])) == {0: 12}
    assert runs(es, " ".join(w[:6] + ["zz"] + w[6:12])) == {}
    assert runs(es, "日" + "。 ".join(JA[10:40])) == {9: 30} and runs(es, JA[10:39]) == {}
    assert runs(es, None) == runs(es, "") == {}
    assert runs(es, " ".join(w[:20]) + " q " + ITEM[1] + " q " + " ".join(w[:15])) == {0: 20, 1: 40}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=60), st.lists(st.integers(0, 3), min_size=12, max_size=40))
def test_guarantee_words(doc, item):
    d, i = " ".join(f"v{x}" for x in doc), " ".join(f"v{x}" for x in item)
    assert bool(runs(L.EvalSet([(1, "en", i)]), d)) == brute(d, i, L.words, 12)


@settings(max_examples=150, deadline=None)
@given(st.text("あいう", max_size=90), st.text("あいう", min_size=30, max_size=60))
def test_guarantee_characters(doc, item):
    assert bool(runs(L.EvalSet([(1, "ja", item)]), doc)) == brute(doc, item, L.characters, 30)


def test_both_ways_agree(spark):
    docs = [(k, " ".join(RNG.choice(VOCAB) for _ in range(50)) + " " + " ".join(ITEM[k % 5].split()[k % 20 : k % 20 + 5 + k % 12])) for k in range(120)] + [(500, None), (501, ""), (502, ITEM[2] * 200), (503, JA), (503, JA)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(i, "en", t) for i, t in enumerate(ITEM)] + [(9, "ja", JA), (9, "ja", JA)], "item_id bigint, lang string, text string")
    one = {(r.item_id, r.doc_id) for r in L.leaks(d, items).collect()}
    two = {(r.item_id, r.doc_id) for r in L.leaks(d, items, max_sent_chars=0).collect()}
    want = {(i, k) for k, t in docs if t for i, x in enumerate(ITEM) if brute(t, x, L.words, 12)} | {(9, 503)}
    assert one == two == want
    assert L.leaks(d.limit(0), items).count() == L.leaks(d, items.limit(0)).count() == 0
