"""Splits and mixtures."""

import random

import numpy as np
import pytest

from corpusmill.functions.web import outlet
from corpusmill.llm import mixing, splits

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def test_largest_differencing_is_balanced():
    r = random.Random(1)
    w = {i: r.randint(1, 100) for i in range(300)}
    bins = splits.largest_differencing(w, 16)
    sums = [sum(w[i] for i in b) for b in bins]
    assert sorted(i for b in bins for i in b) == sorted(w) and max(sums) - min(sums) <= 2
    assert splits.largest_differencing({}, 3) == [[], [], []]


def test_split_keeps_outlets_together(spark):
    r = random.Random(2)
    spell = [lambda h: h, lambda h: f"https://www.{h}/x?y", lambda h: f"{h}:443", lambda h: f"//{h}/rss.xml", lambda h: h.upper() + "."]
    rows = [(i, r.choice(spell)(f"site{min(39, int(r.expovariate(0.1)))}.example"), "clash") for i in range(3000)]
    rows += [(i, x, "") for i, x in enumerate([None, "", "nan", "Unknown", " "] * 30, 5000)]
    df = spark.createDataFrame([*rows, rows[0]], "row_seq long, source_uri string, outlet string")
    got = splits.split(df, "row_seq", "source_uri", SHARES).collect()
    assert len(got) == len(rows) + 1
    by = {}
    for x in got:
        if x.outlet:
            by.setdefault(x.outlet, set()).add(x.split)
    assert all(len(v) == 1 for v in by.values()) and len(by) <= 40
    shares = {x.split: x for x in splits.proportions(splits.split(df, "row_seq", "source_uri", SHARES), SHARES).collect()}
    assert all(abs(x.share - x.target) < 0.02 for x in shares.values())
    assert splits.split(df.limit(0), "row_seq", "source_uri", SHARES).count() == 0


def test_one_outlet_with_most_rows(spark):
    df = spark.createDataFrame([(i, "big.example" if i % 3 else f"s{i}.example") for i in range(900)], "row_seq long, source_uri string")
    got = {x.split: x.rows for x in splits.proportions(splits.split(df, "row_seq", "source_uri", SHARES), SHARES).collect()}
    assert got["train"] == 720


def test_same_outlet(spark):
    v = ["kőhalmi.example", "xn--khalmi-6nb.example", "WWW.Kőhalmi.example", "https://user@kőhalmi.example:8080/a", "other.example", "nan", "", None, "unknown", "feed@other.example", "http://other.example?x"]
    got = {(r.source_a, r.source_b) for r in splits.same_outlet(spark.createDataFrame([(x,) for x in v * 2], "source_uri string"), "source_uri").collect()}
    want = {(a, b) for a in set(v) for b in set(v) if a and b and a < b and outlet(a) and outlet(a) == outlet(b)}
    assert got == want and len(want) >= 6


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    tokens = rng.integers(10, 2000, 500).astype(float)
    p = np.full(500, 0.37)
    q = mixing.flight(p, tokens, rng)
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= mixing.LANDING
    assert q.sum() == pytest.approx(p.sum()) and (q * tokens).sum() == pytest.approx((p * tokens).sum())
    done = mixing.landing(q, tokens, rng)
    assert set(done) <= {0, 1} and abs((done * tokens).sum() - (p * tokens).sum()) < 50
    # chances are those wanted
    draws = np.mean([mixing.landing(mixing.flight(np.full(200, 0.4), tokens[:200], np.random.default_rng(s)), tokens[:200], np.random.default_rng(s)) for s in range(300)], axis=0)
    assert abs(draws.mean() - 0.4) < 0.01
    # the shortest ones are decided by the landing phase, the others by chance
    by_chance = draws[np.argsort(-tokens[:200])[:150]]
    assert by_chance.min() > 0.28 and by_chance.max() < 0.52


@pytest.fixture(scope="module")
def tokenizer():
    import os

    if not os.path.exists(mixing.TOKENIZER):
        pytest.skip("no tokenizer here")
    return mixing.TOKENIZER


def test_token_counts_are_those_of_the_tokenizer(tokenizer):
    c = mixing.TokenCounts(tokenizer)
    for t in ("Один суд пообіцяв.\n\n  «Той» мер", "It's 1234 tokens,  don't!", "árvíztűrő\ttükörfúrógép ", "🙂" * 5):
        assert c.count(t) == len(c.encoding.encode_ordinary(t))


def test_mixture_reaches_its_shares(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 100)
    r = random.Random(4)
    rows = [(i, ["a", "b", "c", "lost"][min(3, int(r.expovariate(1)))], " ".join(r.choices(["uno", "zwei", "three"], k=r.randint(1, 60))), 0) for i in range(900)]
    rows += [(2000, "a", None, 0), (2001, "b", "  ", 0), (2002, None, "x y", 0), (None, "a", "x", 0), (2003, "c", "word " * 400, 0)]
    d = spark.createDataFrame([*rows, rows[0]], "doc_id long, source string, text string, tokens int")
    targets = [("a", 0.2, 2), ("b", 0.3, 1), ("c", 0.4, 3), ("none", 0.1, 5), (None, 0.5, 1)]
    t = spark.createDataFrame([*targets, targets[0]], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(d, t)
    got = chosen.collect()
    cap = {s: m for s, _, m in targets}
    assert len({x.doc_id for x in got}) == len(got) and all(1 <= x.repeats <= cap[x.source] for x in got)
    by = {x.source: x for x in shares.collect()}
    assert by["lost"].share == 0 and by["none"].share == 0 and by["none"].target_share == 0.1
    for s, w in (("a", 0.2), ("b", 0.3), ("c", 0.4)):
        assert abs(by[s].share - w / 0.9) < 0.004
    # a size that not every source can fill: those give all they may
    by = {x.source: x for x in mixing.mix(d, t, size=10**7)[1].collect()}
    assert all(by[s].tokens_used == by[s].tokens * cap[s] for s in ("a", "b", "c"))
    assert mixing.mix(d.limit(0), t)[0].count() == 0 == mixing.mix(d, t.limit(0))[0].count()
