import pytest

from talkloom.llm import residue as R

GOOD = [f"We measured {i} ms for the index and kept the lock file.\n\nAdding a counter to part {i} should stop it." for i in range(200)]
TALK = [f"We log \"504 Gateway Timeout\" when host{i}.example is slow, and the retry of run {i} hides it. The client then signs in again and reads the rest of the rows." for i in range(40)]
CODE = [f"Both forms give line {i}.\n\n```\nprint('{{{{ name }}}}', ${{HOME}})\n```\nUse `{{{{x}}}}` there, as the test for part {i} shows." for i in range(40)]
SHORT = ["ok", "thanks, closing this", "see above", "了解"] * 8
PAGES = [p for i in range(24) for p in (f"h{i}.example is down for planned maintenance, come back at {i}:00.", f"Sign in to h{i}.example\nEmail\nPassword\nForgot password?", f"{400 + i % 4} Forbidden\n\nproxy/1.{i}", '{"error": {"code": 503, "message": "Service Unavailable"}}', "Please enable JavaScript in your browser to continue.", "We use cookies. Accept all | Reject all", "asdf asdf asdf qwer qwer", "Sample text. Sample text goes here.", "お探しのページは見つかりませんでした。")]
HOLES = [f"{g}\n\nHello {m}, your summary of run {i} is ready." for i, (g, m) in enumerate(zip(GOOD, ["{{name}}", "${NAME}", "<%= name %>", "[FIRST_NAME]", "%NAME%", "__NAME__", "@@name@@", "<<name>>"] * 5))]


@pytest.fixture(scope="module")
def model():
    return R.ResidueModel().fit([(t, None) for t in GOOD + TALK + CODE + SHORT + PAGES + HOLES])


def test_unseen_hosts(model):
    n, precision, recall = model.unseen
    assert n > 30 and precision > 0.85 and recall > 0.75


@pytest.mark.parametrize("text, want", [(t, False) for t in (GOOD[3], TALK[5], CODE[7], "ok", "see above", "", None, "   ")] + [(t, True) for t in (PAGES[4], "new.example is down for planned maintenance, come back at 3:00.", HOLES[1], HOLES[6], "Note.\n\nHello {{other}}, your summary of run 7 is ready.", ("Row kept. " * 3000) + "\n\nHello ${WHO}, your summary of run 1 is ready.")])
def test_documents(model, text, want):
    assert (model.probability([(text, "t")])[0] >= model.cut) == want


def test_score(spark):
    rows = [(i, t, None, "x") for i, t in enumerate(GOOD + PAGES + SHORT)] + [(9999, None, None, "x"), (0, GOOD[0], None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, title string, residue string")
    out = R.score(df).collect()
    assert len(out) == len(rows)
    said = {r.doc_id for r in out if r.residue}
    pages = set(range(len(GOOD), len(GOOD) + len(PAGES)))
    assert len(said & pages) >= 0.97 * len(pages) and len(said - pages) <= 2
    assert R.score(df.limit(0)).count() == 0


def test_the_model_goes_beyond_its_labels(model):
    """Pages whose phrases the label list does not know: the rule finds none of them, the model most."""
    new = [f"h{i}.example is {what}, come back at {i}:00." for i in range(60, 64) for what in ("down for some hours", "closed for planned work")] + [f"Sign-in for h{i}.example\nEmail\nPassword\nForgotten it?" for i in range(60, 64)]
    rule = sum(R.weak_label(u, s) for t in new[:8] for u, s in R.units(t))
    p = model.probability([(t, None) for t in new])
    assert rule == 0 and (p[:8] >= model.cut).mean() > 0.5
    assert all(model.probability([(t, None)])[0] < model.cut for t in GOOD[50:60] + TALK[:5] + CODE[:5])
