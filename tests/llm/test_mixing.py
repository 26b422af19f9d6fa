import pytest

from weftgraph.llm import mixing as M
from weftgraph.llm.tokens import count_tokens


def make(spark, n=400):
    rows = [(i, ["Big One", "big_one ", "BIG-ONE", "mid", "tiny", "none", None][i % 7], "word " * (1 + i % 13), 9) for i in range(n)]
    rows += [(n, "mid", None, 9), (n + 1, "tiny", "", 9)]
    targets = [("big_one", 0.3, 2), ("mid", 0.3, 5), ("tiny", 0.4, 2), ("absent", 0.1, 1), (None, 0.1, 1), ("zero", 0.0, 3), ("nullrep", 0.2, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def brute(rows, shares, budget):
    have = {}
    for i, s, t, _ in rows:
        s = (s or "").lower().strip().replace("-", "_").replace(" ", "_")
        have.setdefault(s, []).append((i, int(count_tokens([t])[0])))
    return {s: sum(n for _, n in v) for s, v in have.items()}


@pytest.mark.parametrize("bucket_docs", [20_000, 25])
def test_mixture(spark, bucket_docs):
    rows, docs, targets = make(spark)
    mixture, report = M.mix(docs, targets, bucket_docs=bucket_docs)
    sums = brute(rows, None, None)
    budget = sum(sums.values())
    got = sorted(mixture.collect(), key=lambda r: r.cum_tokens)
    run = 0
    for a, b in zip(got, got[1:]):
        assert (a.finish, a.source, a.repeat, a.doc_id) < (b.finish, b.source, b.repeat, b.doc_id)
    for r in got:
        run += r.tokens
        assert r.cum_tokens == run
    assert run >= budget > run - got[-1].tokens
    assert len({(r.doc_id, r.repeat) for r in got}) == len(got)
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == {"big_one", "mid", "tiny", "absent"}
    assert rep["tiny"].short and rep["absent"].short and not rep["mid"].short
    assert rep["tiny"].actual_tokens == 2 * sums["tiny"] and rep["tiny"].repeats_used == 2
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    assert abs(rep["mid"].actual_tokens - rep["big_one"].actual_tokens) < 60  # equal weights, both with enough


def test_shares_are_met_when_all_sources_suffice(spark):
    _, docs, _ = make(spark, 2000)
    targets = spark.createDataFrame([("big_one", 0.6, 3), ("mid", 0.25, 3), ("tiny", 0.15, 3)], "source string, target_share double, max_repeats int")
    rep = {r.source: r.actual_share for r in M.mix(docs, targets, bucket_docs=100)[1].collect()}
    assert all(abs(rep[s] - t) < 0.005 for s, t in (("big_one", 0.6), ("mid", 0.25), ("tiny", 0.15)))


def test_budget_beyond_everything_and_empty(spark):
    rows, docs, targets = make(spark, 70)
    mixture, report = M.mix(docs, targets, budget=10**9)
    sums = brute(rows, None, None)
    assert {r.source: r.actual_tokens for r in report.collect()} == {"big_one": 2 * sums["big_one"], "mid": 5 * sums["mid"], "tiny": 2 * sums["tiny"], "absent": 0}
    mixture, report = M.mix(docs.limit(0), targets)
    assert mixture.count() == 0 and {r.actual_share for r in report.collect()} == {0.0}
    assert M.mix(docs, targets.limit(0))[1].count() == 0
