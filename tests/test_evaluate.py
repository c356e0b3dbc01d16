import hashlib

import numpy as np
import pytest

from punctua.operators import evaluate, integrity


def frame(spark, cases):
    rows = [(name, float(p), int(y), i) for name, pairs in cases.items()
            for i, (p, y) in enumerate(pairs)]
    return spark.createDataFrame(rows, "model string, probability double, target int, id long")


def test_literals_and_pairwise_definition(spark):
    rng = np.random.default_rng(3)
    cases = {
        "perfect": [(.05, 0), (.20, 0), (.80, 1), (.95, 1)],
        "ties": [(.5, 0), (.5, 1), (.5, 1), (.2, 0), (.9, 0), (.9, 1)],
        "step": [(.1, 0), (.4, 0), (.35, 1), (.8, 1)],
        "single": [(.1, 0), (.9, 0)],
    }
    for i in range(30):
        n = rng.integers(4, 40)
        cases[f"r{i}"] = list(zip(rng.integers(0, 6, n) / 5,
                                  np.append(rng.integers(0, 2, n - 2), [0, 1])))
    got = {r.model: r for r in evaluate.metrics(frame(spark, cases), ["model"]).collect()}
    perfect = got["perfect"]
    assert perfect.roc_auc == perfect.pr_auc == perfect.f1 == perfect.accuracy == 1.0
    assert perfect.brier < 0.03
    assert got["ties"].roc_auc == pytest.approx(0.611111, abs=1e-6)
    assert got["ties"].pr_auc == pytest.approx(0.566667, abs=1e-6)
    assert got["step"].roc_auc == 0.75 and got["step"].pr_auc == pytest.approx(0.833333, abs=1e-6)
    single = got["single"]
    assert single.roc_auc is None and single.f1 == 0.0 and single.accuracy == 0.5
    for name, pairs in cases.items():
        if name == "single":
            continue
        p, y = map(np.array, zip(*pairs))
        gaps = p[y == 1][:, None] - p[y == 0][None, :]
        assert got[name].roc_auc == pytest.approx(((gaps > 0) + (gaps == 0) / 2).mean())
        ap, seen = 0.0, 0.0
        for cut in sorted(set(p), reverse=True):
            recall = y[p >= cut].sum() / y.sum()
            ap += (recall - seen) * y[p >= cut].mean()
            seen = recall
        assert got[name].pr_auc == pytest.approx(ap)


def test_bootstrap_skips_single_class_replicates(spark):
    rows = frame(spark, {"m": [(.1, 0), (.9, 1)]}).drop("model")
    table = evaluate.bootstrap(rows, "id", 3, "b")
    assert table.count() == 3 and table.where("roc_auc is null").count() == 0
    one = frame(spark, {"m": [(.1, 0), (.9, 0)]}).drop("model")
    with pytest.raises(RuntimeError):
        evaluate.bootstrap(one, "id", 1, "b")


@pytest.mark.parametrize("block", [4096, 7])
def test_draws_lead_to_the_rows_of_the_score_order(spark, monkeypatch, block):
    """A hot score that reaches into many blocks, and draws against a plain lookup."""
    monkeypatch.setattr(evaluate, "BLOCK", block)
    scores = [(.5, i % 3 == 0) for i in range(60)] + [(i / 50, i % 2) for i in range(30)]
    rows = frame(spark, {"m": [(p, int(y)) for p, y in scores]}).drop("model")
    table = evaluate.draw_table(rows)
    assert table.rows == 90
    got = {(r.replicate, r.p): (r.pos, r.neg)
           for r in evaluate.bootstrap_cells(table, (2, 5), "s").collect()}
    ordered, want = sorted(scores, key=lambda r: (r[0], not r[1])), {}
    for replicate in range(2, 5):
        for draw in range(90):
            digest = hashlib.md5(f"s|{replicate}|{draw}".encode()).hexdigest()
            p, y = ordered[int(digest[:12], 16) % 90]
            pos, neg = want.get((replicate, p), (0, 0))
            want[replicate, p] = (pos + bool(y), neg + (not y))
    assert got == want


def test_a_draw_is_hashed_once(spark, capsys):
    """No filter of the join takes the hash a second time."""
    rows = frame(spark, {"m": [(i / 30, i % 2) for i in range(30)]}).drop("model")
    evaluate.bootstrap_cells(evaluate.draw_table(rows), (0, 2), "s").explain()
    assert capsys.readouterr().out.count("md5(") == 1


def test_calibration_keeps_ties_together(spark):
    rows = frame(spark, {"m": [(.5, i % 2) for i in range(20)] + [(.1, 0), (.9, 1)]})
    table = evaluate.calibration(rows, 4).orderBy("bin").collect()
    assert sum(r["rows"] for r in table) == 22
    assert [r["rows"] for r in table if r.mean_predicted == pytest.approx((20 * .5 + .1) / 21)] == [21]
    with pytest.raises(ValueError):
        evaluate.require_probabilities(frame(spark, {"m": [(1.5, 0)]}))


def test_ordered_hash(spark):
    def digest(ids):
        df = spark.createDataFrame(list(enumerate(ids)), "pos long, id long").repartition(3)
        return integrity.sequence_hash(df, "pos", "id").first()["sha256"]

    assert digest([4, 2, 8]) == digest([4, 2, 8]) != digest([2, 4, 8])
