"""Bootstrap, pairwise fits and leaderboard details against small references."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import comparison as M
from gaugeworks.operators import judging as J
from gaugeworks.operators import pairwise as W


@pytest.fixture()
def cells(spark):
    rows = [("x/m1", 1.0, 30), ("x/m1", 0.5, 20), ("x/m1", 0.0, 50), ("m2", 1.0, 5), ("m2", 0.0, 5)]
    exploded = [(m, s) for m, s, n in rows for _ in range(n)]
    return J.score_cells(spark.createDataFrame(exploded, "model string, scores double"))


def test_cells_and_means(cells):
    got = {r["model"]: (round(r["score"], 6), r["n_battles"]) for r in J.means(cells).collect()}
    assert got == {"m1": (0.4, 100), "m2": (0.5, 10)}


def test_bootstrap_is_seeded_and_centred(cells):
    a = J.bootstrap_means(cells, n_bootstrap=400, seed=1)
    b = J.bootstrap_means(cells.repartition(5), n_bootstrap=400, seed=1)
    key = ["model", "replicate", "mean"]
    assert sorted(map(tuple, a.select(key).collect())) == sorted(map(tuple, b.select(key).collect()))
    s = {r["model"]: r for r in J.replicate_summary(a).collect()}
    # standard error of the mean of m1: sqrt(var / n)
    var = (30 * 0.6**2 + 20 * 0.1**2 + 50 * 0.4**2) / 100
    assert abs(s["m1"]["score"] - 0.4) < 4 * np.sqrt(var / 100 / 400)
    spread = (s["m1"]["upper"] - s["m1"]["lower"]) / 2
    assert abs(spread - 1.645 * np.sqrt(var / 100)) < 0.02


def test_null_games_and_scores(spark):
    game = "struct<score:string,judgment:struct<answer:string>>"
    df = spark.createDataFrame(
        [
            (1, "m", [("A>B", ("t",)), ("A>>B", ("t",))]),
            (2, "m", [None, ("A=B", ("t",))]),
            (3, "m", [(None, ("t",)), ("A=B", ("t",))]),
        ],
        f"uid int, model string, games array<{game}>",
    )
    rows = J.battles(J.game_scores(df)).collect()
    # game 2 as it is (three times), then one minus game 1
    assert [r["scores"] for r in rows] == [1.0, 1.0, 1.0, 0.0]
    text = df.filter("uid = 1").select(J.judge_outputs_text()).first()[0]
    assert text.startswith("(Judge output 1):\nt\n---") and text.endswith("(Judge output 2):\nt")


def test_cells_from_verdicts_equal_cells_from_battles(spark):
    verdicts = ["A>B", "A>>B", "A=B", "B>A", "B>>A", "A<B", None]
    rows = [(i, f"m{i % 3}", verdicts[i % 7], verdicts[(i * 3) % 7]) for i in range(200)]
    df = spark.createDataFrame(rows, "uid int, model string, game1 string, game2 string")
    a = J.cells_from_judgments(df).collect()
    b = J.score_cells(J.battles(df)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_leaderboard_text(spark):
    df = spark.createDataFrame([("a", 0.4, 0.31, 0.46)], "model string, score double, lower double, upper double")
    rows = {r["model"]: r for r in J.leaderboard(df, baseline="base").collect()}
    assert rows["a"]["score"] == 40.0 and rows["a"]["ci"] == "(-9.0 / +6.0)"
    assert rows["base"]["score"] == 50.0 and rows["base"]["ci"] == "(-0.0 / +0.0)"
    assert J.leaderboard(df, baseline="a").count() == 1


def test_judge_inputs_checks(spark):
    convo = "array<struct<role:string,content:string>>"
    q = spark.createDataFrame([("1", "ei", [("user", "q")])], f"uid string, category string, convo {convo}")
    def answers(rows):
        return spark.createDataFrame(rows, f"uid string, model string, messages {convo}")

    good = answers([("1", "m", [("user", "q"), ("assistant", "x")]), ("1", "b", [("user", "q"), ("assistant", "y")])])
    rows = J.judge_inputs(q, good, "b").orderBy("game").collect()
    assert [(r["answer_a"], r["answer_b"]) for r in rows] == [("y", "x"), ("x", "y")]
    with pytest.raises(Exception, match="baseline answer missing"):
        J.judge_inputs(q, good.filter("model = 'm'"), "b").collect()
    bad = answers([("1", "m", [("user", "other"), ("assistant", "x")]), ("1", "b", [("user", "q"), ("assistant", "y")])])
    with pytest.raises(Exception, match="history differs"):
        J.judge_inputs(q, bad, "b").collect()
    assert J.judge_inputs(q, good.filter("model = 'b'"), "b").count() == 0


def numpy_logit(x, y, w, steps=60, l2=None):
    beta = np.zeros(x.shape[1])
    pen = np.zeros(x.shape[1]) if l2 is None else l2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        g = x.T @ (w * (p - y)) + pen * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(pen)
        beta = beta - np.linalg.pinv(h) @ g
    return beta


def test_logistic_matches_numpy(spark):
    rng = np.random.default_rng(3)
    models, n = ["a", "b", "c"], 300
    data = [(models[i % 3], float(rng.choice([0, 0.5, 1])), float(rng.normal())) for i in range(n)]
    df = spark.createDataFrame(data, "model string, scores double, f_length double").repartition(4)
    rows, names = W.design(df, ["f_length"], "base")
    assert names == ["a", "b", "base", "c", "f_length"]
    fit = W.logistic_bootstrap(rows, names, baseline="base", n_bootstrap=3, seed=5)
    got = fit[fit["replicate"] == 0].set_index("name")["coef"]
    x = np.array([[m == "a", m == "b", -1, m == "c", f] for m, _, f in data], float)
    want = numpy_logit(x, np.array([s for _, s, _ in data]), np.ones(n))
    for i, m in enumerate(["a", "b", "base", "c"]):
        assert abs((got[m] - got["base"]) - (want[i] - want[2])) < 1e-6
    assert abs(got["f_length"] - want[4]) < 1e-6
    again = W.logistic_bootstrap(rows, names, baseline="base", n_bootstrap=3, seed=5)
    assert len(again) == 4 * 5 and fit[fit["replicate"] > 0]["coef"].std() > 0


def test_binary_with_intercept_and_penalty(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 2))
    y = (x[:, 0] + rng.normal(size=120) > 0.3).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b), 1) for a, b in zip(x, y)], "x array<double>, y double, n bigint")
    fit = W.logistic_bootstrap(rows, ["u", "v"], n_bootstrap=0, intercept=True, l2=1.0).set_index("name")["coef"]
    want = numpy_logit(np.hstack([x, np.ones((120, 1))]), y, np.ones(120), l2=np.array([1.0, 1.0, 0.0]))
    assert np.allclose([fit["u"], fit["v"], fit["intercept"]], want, atol=1e-6)


def test_resamples_do_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(8)
    data = [([1.0, float(rng.normal())], float(rng.integers(0, 2)), int(rng.integers(1, 4))) for _ in range(200)]
    rows = spark.createDataFrame(data, "x array<double>, y double, n bigint")
    fits = [
        W.logistic_bootstrap(rows.repartition(k), ["u", "v"], n_bootstrap=4, seed=1).set_index(["replicate", "name"])
        for k in (1, 3, 16)
    ]
    assert fits[0]["converged"].all() and fits[0]["coef"].std() > 0
    for other in fits[1:]:
        assert np.allclose(fits[0]["coef"], other.loc[fits[0].index, "coef"], atol=1e-8)
    few = W.logistic_bootstrap(rows, ["u", "v"], n_bootstrap=0, max_steps=1)
    assert not few["converged"].any()


def test_bt_closed_form(cells):
    got = {r["model"]: r["coef"] for r in W.coefficients(cells).collect()}
    assert abs(got["m1"] - np.log(0.4 / 0.6)) < 1e-12 and abs(got["m2"]) < 1e-12


def test_tie_model_is_stationary(cells):
    fit = W.tie_model(cells).collect()
    coef = {r["model"]: r["coef"] for r in fit}
    eta = fit[0]["eta"]
    index = {"m1": 0, "m2": 1}
    data = [(index[r["model"]], r["scores"], r["n"]) for r in cells.collect()]

    def loss(theta):
        total = 0
        for i, s, n in data:
            v, _, _ = W._rk_terms(np.array([theta[i]]), theta[-1], np.array([s]))
            total += n * v[0]
        return total

    best = np.array([coef["m1"], coef["m2"], eta])
    for j in range(3):
        for d in (-1e-3, 1e-3):
            moved = best.copy()
            moved[j] += d
            assert loss(moved) >= loss(best) - 1e-9


def test_ranks_ignore_invalid(spark):
    rows = spark.createDataFrame(
        [("l", "a", 2.0, 0), ("l", "b", float("nan"), 1), ("l", "c", 2.0, 2), ("l", "", 9.0, 3), ("l", "d", None, 4), ("l", "e", 3.0, 5)],
        "lb_id string, model string, score double, pos int",
    )
    got = {r["model"]: r["rank"] for r in M.ranks(rows).collect()}
    assert got == {"e": 1, "a": 2, "c": 3}


def test_natural_order_and_columns(spark):
    rows = spark.createDataFrame([("m10", 1.0, "x"), ("M2", None, "y"), ("m1", 3.0, "z")], "model string, score double, extra string")
    assert [r["model"] for r in M.sort_rows(rows, "model", ascending=True).collect()] == ["m1", "M2", "m10"]
    assert [r["model"] for r in M.sort_rows(rows, "score").collect()] == ["m1", "m10", "M2"]
    assert M.column_order(rows.select("extra", "score", "model")).columns == ["model", "score", "extra"]


def test_comparison_summary(spark):
    df = spark.createDataFrame([("h1", 0.2, {"a": 0.7, "b": 0.6}), ("h2", 0.9, {"c": 0.1})], "hypothesis string, mu double, sample2score map<string,double>")
    assert [(r["hypothesis"], r["samples"]) for r in M.comparison_summary(df).collect()] == [("h2", []), ("h1", ["a"])]


def test_style_metadata(spark):
    df = spark.createDataFrame([({"length": "12", "bold": '{"a": 1, "b": 2}'},)], "metadata map<string,string>")
    got = df.select(*W.metadata_counts(F.col("metadata"), ["length", "bold"])).first()
    assert (got["length"], got["bold"]) == (12.0, 3.0)
