import os
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from feedloom.llm import mixing, tokens

P = st.floats(0.01, 0.99)


@given(P, st.integers(1, 5000), P, st.integers(1, 5000), st.floats(0, 0.999999))
def test_settle_keeps_mass(pa, na, pb, nb, u):
    a, b = mixing.settle(pa, na, pb, nb, u)
    assert abs(a * na + b * nb - pa * na - pb * nb) < 1e-6 * (na + nb)
    assert min(abs(a), abs(1 - a), abs(b), abs(1 - b)) < 1e-9 and -1e-9 <= min(a, b) and max(a, b) <= 1 + 1e-9


def test_settle_keeps_expectation():
    rng = random.Random(1)
    for pa, na, pb, nb in ((0.3, 10, 0.6, 25), (0.9, 3, 0.8, 7), (0.1, 100, 0.2, 1)):
        n = 20000
        mean = sum(mixing.settle(pa, na, pb, nb, rng.random())[0] for _ in range(n)) / n
        assert abs(mean - pa) < 0.015


@pytest.mark.skipif(not os.path.exists(os.path.join(tokens.VOCABULARIES, tokens.VOCABULARY)), reason="no vocabulary here")
def test_mix(spark):
    rng = random.Random(2)
    rows = [(k, "big" if k % 3 == 0 else rng.choice(["mid", "small", "other", None]), rng.choice([None, "", "word " * rng.randrange(1, 40)])) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 as n_tokens", "2 as copies", "3 as part").repartition(7)
    targets = spark.createDataFrame([("big", 0.2, 1), ("mid", 0.5, 3), ("small", 0.3, 2), ("absent", 0.0, 1), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(docs, targets).cache()
    got = mix.collect()
    caps = {"big": 1, "mid": 3, "small": 2}
    assert len({r.doc_id for r in got}) == len(got) and all(1 <= r.copies <= caps[r.source] and r.n_tokens > 0 for r in got)
    shares = {r.source: r for r in mixing.shares(mix, targets).collect()}
    for s, want in (("big", 0.2), ("mid", 0.5), ("small", 0.3)):
        assert abs(shares[s].actual_share - want) < 0.01
    assert shares["absent"].actual_share == 0
    assert mixing.mixed(docs.limit(0), targets).count() == 0
    assert mixing.mixed(docs, targets.limit(0)).count() == 0
    # the same mix however the rows lie
    again = mixing.mixed(docs.repartition(3), targets).collect()
    assert {(r.doc_id, r.copies) for r in again} == {(r.doc_id, r.copies) for r in got}
    small = mixing.mixed(docs, targets, total=500.0).collect()
    assert abs(sum(r.n_tokens * r.copies for r in small) - 500) < 120
