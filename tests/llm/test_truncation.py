import random

from talkloom.llm import truncation as T

RNG = random.Random(4)
NOUNS = ["the index", "a lock file", "the digest renderer", "old results", "the config loader"]


def sentence():
    return RNG.choice([f"We measured {RNG.randrange(900)} ms for {RNG.choice(NOUNS)}.", f"Adding a counter to {RNG.choice(NOUNS)} should stop it.", f"Please keep {RNG.choice(NOUNS)} in mind before {RNG.choice(NOUNS)} moves.", f"Why is {RNG.choice(NOUNS)} so slow?"])


def text(n):
    return " ".join(sentence() for _ in range(n))


WHOLE = [text(RNG.randrange(2, 9)) for _ in range(700)] + ["ok", "run it again", "hmm, let me check..."] * 25
CUT = []
for k in range(60):
    whole = text(6)
    at = RNG.randrange(30, len(whole) - 40)
    while whole[at - 1] in ".?! ":
        at += 1
    CUT.append(whole[:at] + ["", "…", " [truncated]"][k % 3])


def test_marks():
    assert T.split_mark("abc [...]") == ("abc", " [...]") and T.split_mark("abc…(以下略)") == ("abc", "…(以下略)") and T.split_mark("abc (cut, 12 KB total)")[0] == "abc"
    assert T.split_mark("[truncated] is a label") == ("[truncated] is a label", "") and T.split_mark("x)") == ("x)", "")


def test_scores(spark):
    limited = [text(30)[:512] for _ in range(80)]
    rows = [(f"w{i}", "free", t) for i, t in enumerate(WHOLE)] + [(f"c{i}", "free", t) for i, t in enumerate(CUT)] + [(f"l{i}", "limited", t) for i, t in enumerate(limited)] + [("n", "free", None), ("b", "free", " ​"), ("e", None, ""), ("w0", "free", WHOLE[0])]
    df = spark.createDataFrame(rows, "event_id string, source_kind string, text string")
    out = {r.event_id: r.cut_probability for r in T.find_cut(df, ["event_id"]).collect()}
    assert not {"n", "b", "e"} & set(out)
    said = {k for k, p in out.items() if p >= T.CUT}
    assert len([k for k in said if k[0] == "c"]) >= 48  # of 60 cut values, in a corpus of a few hundred texts
    assert len([k for k in said if k[0] == "w"]) <= 15  # of 775 whole ones
    ended = {f"l{i}" for i, t in enumerate(limited) if t[-1] not in ".?"}
    assert len(ended & said) >= 0.9 * len(ended)
    limit = {(r.source, r.size) for r in T.length_limits(df, "source_kind", "text").collect()}
    assert ("limited", 512) in limit
    assert T.find_cut(df.limit(0), ["event_id"]).count() == 0


def test_held_out_accuracy():
    model = T.CutModel(frozenset(w.lower().strip(".?") for t in WHOLE for w in t.split())).fit(WHOLE + CUT, [False] * (len(WHOLE) + len(CUT)))
    assert model.accuracy > 0.95
    assert 0.01 < model.prior < 0.2
