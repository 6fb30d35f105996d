import numpy as np
import pytest

from arborlake.llm import mixing as mx

WORDS = {"xa": ["kato", "mila", "rosu"], "yb": ["öl", "grün", "bär"], "zc": ["the", "thing", "sing"]}
SIZE = {"xa": 120, "yb": 30, "zc": 10}


def corpus(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows, key = [], 0
    for lang, n in SIZE.items():
        for _ in range(n):
            other = list(WORDS)[rng.integers(3)]
            text = " ".join(rng.choice(WORDS[lang], rng.integers(5, 60))) + " " + " ".join(rng.choice(WORDS[other], 3))
            rows.append((key, text, lang if key % 4 else None, "s"))
            key += 1
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rate string").repartition(4)


def joint(tokens, posterior):
    return (posterior * tokens[:, None]).T @ posterior + np.eye(posterior.shape[1]) * 1e-9 * (tokens.sum() + 1)


def plain_rates(tokens, posterior, targets, least, rounds=4000):
    """Projected gradient on the same goal with numpy, run much longer."""
    rate = np.ones(len(tokens))
    shared = joint(tokens, posterior)
    for _ in range(rounds):
        rate = np.maximum(least, rate - posterior @ np.linalg.solve(shared, (tokens * rate) @ posterior - targets))
    return rate


@pytest.mark.parametrize("targets", [None, {"xa": 500.0, "yb": 900.0, "zc": 700.0}, {"yb": 100.0, "xa": 100.0, "zc": 2.0}])
def test_totals_meet_targets(spark, targets):
    rows, fitted = mx.mixed(corpus(spark), targets=targets)
    got = rows.select("tokens", "posterior", "rate").collect()
    tokens, posterior, rate = (np.array([r[i] for r in got], float) for i in range(3))
    assert np.allclose(posterior.sum(axis=1), 1) and (rate >= 0).all()
    assert np.allclose((tokens * rate) @ posterior, fitted.totals)
    assert fitted.miss < mx.CLOSE
    assert np.allclose(rate, plain_rates(tokens, posterior, np.array(fitted.targets), 0.0), atol=0.02)


def test_posteriors_name_the_domain(spark):
    docs = corpus(spark)
    rows, fitted = mx.mixed(docs)
    right = [fitted.domains[int(np.argmax(r.posterior))] == ("xa" if r.doc_id < 120 else "yb" if r.doc_id < 150 else "zc") for r in rows.collect()]
    assert np.mean(right) > 0.97


def test_documents_are_repeated_and_none_is_dropped(spark):
    docs = corpus(spark)
    out = mx.repeat_to_targets(docs)
    assert out.columns == docs.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert len(times) == 160 and np.mean([times[i] for i in range(150, 160)]) > 1.5 > np.mean([times[i] for i in range(120)])
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in mx.repeat_to_targets(docs).collect())


def test_odd_rows(spark):
    rows = [(1, None, "xa"), (2, "", None), (3, "kato " * 50_000, "xa"), (3, "kato " * 50_000, "xa"), (None, "öl öl", "yb"), (4, "öl", "yb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = mx.mixing_rates(docs).collect()
    assert len(got) == 6 and all(r.rate >= 0 and r.copies >= 0 for r in got)
    assert mx.mixing_rates(docs.limit(0)).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "nullif('a', 'a') as lang")
    assert {(r.rate, r.miss) for r in mx.mixing_rates(unlabelled).collect()} == {(1.0, 0.0)}


def test_default_targets_shrink_nothing():
    sums = [600.0, 150.0, 0.0]
    targets = mx.default_targets(sums)
    assert all(t >= s - 1e-9 for s, t in zip(sums, targets)) and abs(targets[0] - 600) < 1e-9


def test_written_rates_are_those_of_the_formula(spark, monkeypatch):
    monkeypatch.setattr(mx, "WRITTEN", 1)
    targets = {"xa": 500.0, "yb": 2500.0, "zc": 700.0}
    rows, fitted = mx.mixed(corpus(spark), targets=targets, least=0.9)
    assert len(fitted.steps) > 1
    got = rows.select("tokens", "posterior", "rate").collect()
    tokens, posterior, rate = (np.array([r[i] for r in got], float) for i in range(3))
    assert np.allclose((tokens * rate) @ posterior, fitted.totals) and (rate >= 0.9).all()


def members_of(spark, posterior, seed=1):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(20, 4000, len(posterior)).astype(float)
    rows = [(float(t), p.tolist()) for t, p in zip(tokens, posterior)]
    return tokens, spark.createDataFrame(rows, "tokens double, posterior array<double>").coalesce(2)


def test_mixed_posteriors_and_a_rare_domain_meet_their_targets(spark):
    """Half of every posterior says nothing, and one domain has a hundredth of the tokens."""
    rng = np.random.default_rng(3)
    own = rng.choice(4, 600, p=[0.6, 0.3, 0.09, 0.01])
    posterior = 0.5 * np.eye(4)[own] + 0.125
    tokens, members = members_of(spark, posterior)
    has = tokens @ posterior
    targets = dict(zip("abcd", (has * np.array([0.8, 0.9, 1.3, 1.2])).tolist()))
    fitted = mx.fit_rates(members, list("abcd"), targets)
    assert fitted.miss < mx.CLOSE and len(fitted.steps) < 200
    assert [round(r.total / r.target, 3) for r in fitted.report(spark).collect()] == [1.0] * 4


def test_targets_out_of_reach_end_at_the_optimum(spark):
    rng = np.random.default_rng(4)
    posterior = rng.dirichlet([0.4, 0.4, 0.4], 300)
    tokens, members = members_of(spark, posterior)
    has = tokens @ posterior
    targets = has * np.array([0.2, 1.0, 3.0])  # least rates of 1 leave the first above its target
    fitted = mx.fit_rates(members, list("abc"), dict(zip("abc", targets.tolist())), least=1.0)
    best = plain_rates(tokens, posterior, targets, 1.0, 20_000)
    goal = lambda totals: (totals - targets) @ np.linalg.solve(joint(tokens, posterior), totals - targets)
    assert goal(np.array(fitted.totals)) <= 1.002 * goal((tokens * best) @ posterior)
    assert fitted.miss > 0.1 and len(fitted.steps) < mx.ROUNDS
