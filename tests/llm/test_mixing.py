import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talkloom.llm import mixing as M


def test_budgets():
    exponent, plan = M.budgets({"a": 1000, "b": 1000}, {"a": 0.75, "b": 0.25}, {"a": 2, "b": 1}, 2000)
    assert exponent is None and plan == {"a": 1500.0, "b": 500.0}  # nothing is open
    _, plan = M.budgets({"a": 1000, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 3}, 1010)
    assert plan == {"b": 30.0, "a": 980.0}  # too small: all it may, the other fills up
    assert M.budgets({}, {"a": 1.0}, {"a": 1}, 10) == (None, {})
    assert M.budgets({"a": 5}, {"a": 1.0}, {"a": None}, 10)[1] == {"a": 0.0}


TOKENS = {"a": 6000, "b": 3000, "c": 900, "d": 100}
TARGETS = {"a": 0.4, "b": 0.3, "c": 0.1, "d": 0.2}
REPEATS = {"a": 1, "b": 2, "c": 3, "d": 3}


def test_the_exponent_decides_where_open_tokens_go():
    exponent, plan = M.budgets(TOKENS, TARGETS, REPEATS, 10_000)
    assert plan["d"] == 300 and 0.05 < exponent < 8 and abs(exponent - 1) > 0.05
    spread = {s: plan[s] - TARGETS[s] * 10_000 for s in "abc"}
    assert sum(spread.values()) == pytest.approx(1700) and all(v >= 0 for v in spread.values())
    assert M.entropy(spread) == pytest.approx(M.entropy({s: TARGETS[s] for s in "abc"}), abs=1e-6)
    natural = M.fill({s: min(TARGETS[s] * 10_000, TOKENS[s] * REPEATS[s]) for s in TOKENS}, {s: float(TOKENS[s] * REPEATS[s]) for s in TOKENS}, 1700, M.tempered({s: TOKENS[s] / 9900 for s in "abc"}, 1.0))
    assert max(abs(plan[s] - natural[s]) for s in TOKENS) > 20  # a constant exponent gives another mixture


def test_temperature_plan():
    exponent, plan = M.temperature_plan(TOKENS, TARGETS, dict.fromkeys(TOKENS, 100), 10_000)
    assert 0 < exponent < 1 and M.entropy(plan) == pytest.approx(M.entropy(TARGETS), abs=1e-6) and sum(plan.values()) == pytest.approx(10_000)
    _, capped = M.temperature_plan(TOKENS, TARGETS, REPEATS, 10_000)
    assert capped["d"] == 300 and sum(capped.values()) == pytest.approx(10_000)
    assert M.temperature_plan({}, TARGETS, REPEATS, 10) == (None, {})


def test_many_targets_are_an_error(spark):
    many = spark.range(M.MAX_TARGETS + 1).selectExpr("cast(id as string) source", "0.1D target_share", "1 max_repeats")
    with pytest.raises(ValueError):
        M.read_targets(many)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10**6), st.floats(0.01, 1), st.integers(0, 5)), min_size=1, max_size=8), st.integers(1, 10**7))
def test_budgets_hold(rows, total):
    tokens, targets, repeats = ({i: r[k] for i, r in enumerate(rows)} for k in range(3))
    _, plan = M.budgets(tokens, targets, repeats, total)
    assert sum(plan.values()) <= total * (1 + 1e-9)
    assert all(0 <= plan[i] <= tokens[i] * repeats[i] * (1 + 1e-9) for i in plan)
    full = all(plan[i] >= tokens[i] * repeats[i] * (1 - 1e-9) for i in plan)
    assert full or sum(plan.values()) == pytest.approx(total, rel=1e-6)


def test_mixture(spark):
    text = "one two three four five six seven eight nine ten. "
    docs = [(i, "big", text * (1 + i % 5)) for i in range(3000)] + [(10_000 + i, "small", text * 2) for i in range(100)] + [(20_000, "none", text), (20_001, "big", None), (20_002, "big", ""), (20_003, None, text)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.0, 2), ("missing", 0.2, 2)], "source string, target_share double, max_repeats int")
    out = M.mixture(d, targets).collect()
    uses = {}
    for r in out:
        uses.setdefault(r.doc_id, []).append(r.copy)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in uses.values())
    assert all(len(c) <= (3 if k >= 10_000 else 1) for k, c in uses.items()) and max(uses) < 20_000
    tokens = {(r.doc_id): r.tokens for r in M.count_tokens(d).collect()}
    small, total = sum(t for k, t in tokens.items() if 10_000 <= k < 20_000), sum(t for k, t in tokens.items() if k < 20_000)
    used = {s: sum(r.tokens for r in out if r.source == s) for s in ("big", "small")}
    assert used["small"] == 3 * small and abs(used["big"] - (total - 3 * small)) <= max(tokens.values())
    assert sorted((r.doc_id, r.copy, r.order_key) for r in out) == sorted((r.doc_id, r.copy, r.order_key) for r in M.mixture(d, targets).collect())
    assert len({r.doc_id for r in M.mixture(d, targets, seed=2).collect()} ^ set(uses)) > 10  # another seed, other documents
    rows = {r.source: r for r in M.report(d, targets).collect()}
    assert not rows["small"].reached and rows["small"].most_copies == 3 and rows["missing"].actual_share == 0
    assert rows["big"].exponent is not None
    assert M.mixture(d.limit(0), targets).count() == 0 and M.temperature(d.limit(0), targets).count() == 0
    assert {r.source for r in M.temperature(d, targets).collect()} == {"big", "small"}
