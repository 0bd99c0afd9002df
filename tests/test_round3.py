import numpy as np
import pandas as pd
import pytest
from gaugeworks.operators import hierarchy, ids, pairwise, scale, similarity
from gaugeworks.operators import conversations as conv_ops
from gaugeworks.sources import readers, sinks
from pyspark.sql import functions as F


def test_adjacency_by_bitmaps_is_that_by_rows(spark, monkeypatch):
    """100 titles share a task of many DWAs; small and large tasks overlap; a null title is a title."""
    rng = np.random.default_rng(1)
    rows = [(f"o{t}", "wide", f"d{k}") for t in range(20) for k in range(70)]
    rows += [(f"o{t}", f"task{t}", f"d{k}") for t in range(30) for k in rng.choice(90, rng.integers(1, 12), replace=False)]
    rows += [(None, "wide", "d1"), (None, "wide", "only")] + rows[:5]
    edges = spark.createDataFrame(rows, "title string, task string, dwa string")
    tasks = {}
    for title, task, d in rows:
        tasks.setdefault((title, task), set()).add(d)
    want = sorted({(x, y) for s in tasks.values() for x in s for y in s if x != y})
    for small in (64, 3, 1000):
        monkeypatch.setattr(hierarchy, "SMALL_TASK", small)
        assert sorted(map(tuple, hierarchy.adjacent_dwas(edges).collect())) == want
    assert hierarchy.adjacent_dwas(edges.limit(0)).count() == 0


def test_distinct_texts_with_colliding_hashes(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "id int, text string")
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 3), ("y", 4), ("y", 5), ("z", 9)], "k string, id int")
    want = {"x": 2, "y": 3}

    def counted():
        return {r["k"]: r["n"] for r in scale.distinct_texts(rows, texts, ["k"], "id", "text", "n").collect()}

    assert counted() == want
    # a first hash that tells nothing apart: the texts themselves are compared
    monkeypatch.setattr(scale, "text_hashes", lambda t: [F.lit(1).cast("long").alias("__h"), F.xxhash64(t).alias("__g")])
    assert counted() == want
    pairs = spark.createDataFrame([(1,), (1,), (2,), (3,)], "id int")
    assert tuple(conv_ops.dedupe_counts(pairs, texts, "id", "text").first()) == (4, 3, 2)


def test_distinct_texts_moves_no_text(spark, tmp_path):
    spark.range(50).select("id", F.concat(F.lit("t"), F.col("id") % 7).alias("text")).write.parquet(f"{tmp_path}/t")
    rows = spark.range(50).select("id", (F.col("id") % 3).alias("k"))
    out = scale.distinct_texts(rows, spark.read.parquet(f"{tmp_path}/t"), ["k"], "id", "text", "n")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan.replace("table-", "")
    assert {r["k"]: r["n"] for r in out.collect()} == {0: 7, 1: 7, 2: 7}


def test_global_ids_for_any_layout(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [("b", int(k)) for k in rng.choice(10**6, 300, replace=False)] + [("a", int(k)) for k in range(-20, 90)] + [("c", 2**40)]
    want = {(d, k): i for i, (d, k) in enumerate(sorted(rows))}
    frame = spark.createDataFrame(rows, "dset_name string, local_idx bigint")
    for bucket, parts in ((1 << 16, 3), (64, 11)):
        monkeypatch.setattr(ids, "BUCKET_IDS", bucket)
        out = ids.global_ids(frame.repartition(parts))
        assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        assert {(r["dset_name"], r["local_idx"]): r["instance_idx"] for r in out.collect()} == want
    named = ids.global_ids(frame.withColumn("local_idx", F.format_string("%020d", F.col("local_idx") + 100)))
    assert sorted(r["instance_idx"] for r in named.collect()) == list(range(len(rows)))


def test_repeated_run_replaces_predictions(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, "h", "r", "yes", None, f"m{i % 2}", 5, 3, 2, 0) for i in range(6)],
        "idx int, convo_hash string, request_hash string, response string, error string, model string, "
        "total_tokens int, prompt_tokens int, completion_tokens int, reasoning_tokens int",
    )
    base = str(tmp_path)
    for run, part in (("a", "idx < 4"), ("b", "idx >= 4"), ("a", "idx < 4")):
        sinks.write_predictions(rows.filter(part), base, run=run)
    found = readers.predictions(spark, f"{base}/predictions")
    assert sorted(r["idx"] for r in found.collect()) == list(range(6))
    assert spark.read.json(f"{base}/tokens").count() == 6


def test_arrowhead_step_is_the_full_newton_step():
    rng = np.random.default_rng(5)
    models, dense, n, fits = 4, 3, 60, 3
    m = rng.integers(-1, models, n)
    x = rng.normal(size=(n, dense))
    y, w = rng.choice([0, 0.5, 1], n), rng.integers(0, 4, (n, fits)).astype(float)
    beta = rng.normal(size=(fits, models + dense)) / 5
    sums = pairwise._Sums(fits, models, dense)
    for part in (slice(0, 25), slice(25, n)):
        sums.add(m[part], x[part], y[part], w[part], beta)
    penalty = np.array([0.3] * (models + dense))
    full = np.hstack([np.eye(models + 1)[np.where(m < 0, models, m)][:, :models], x])
    for b, step in enumerate(sums.steps(beta, penalty)):
        p = 1 / (1 + np.exp(-full @ beta[b]))
        g = full.T @ (w[:, b] * (p - y)) + penalty * beta[b]
        h = (full * (w[:, b] * p * (1 - p))[:, None]).T @ full + np.diag(penalty)
        assert np.allclose(step, np.linalg.solve(h, g), atol=1e-8)


@pytest.mark.parametrize("chunk", [7, 20_000])
def test_many_models_and_small_chunks(spark, monkeypatch, chunk):
    """1,000 models with 20 features fit; a resample keeps the number of battles."""
    monkeypatch.setattr(pairwise, "_CHUNK", chunk)
    n_models, n = (1000, 6000) if chunk > 7 else (5, 400)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 20 if chunk > 7 else 2))
    data = pd.DataFrame({"m": [f"m{k % n_models}" for k in range(n)], "x": [v.tolist() for v in x], "y": rng.choice([0, 0.5, 1.0], n), "n": 1})
    rows = spark.createDataFrame(data)
    names = sorted({*data["m"], "base"}) + [f"f{k}" for k in range(x.shape[1])]
    fit = pairwise.logistic_bootstrap(rows, names, baseline="base", n_bootstrap=2, seed=3, l2=0.1)
    assert len(fit) == 3 * len(names) and fit["converged"].all()
    own = fit[fit["replicate"] == 0].set_index("name")["coef"]
    z = own[data["m"]].to_numpy() - own["base"] + x @ own[names[-x.shape[1]:]].to_numpy()
    gap = 1 / (1 + np.exp(-z)) - data["y"]
    assert np.allclose(x.T @ gap + 0.1 * own[names[-x.shape[1]:]].to_numpy(), 0, atol=1e-6)
    assert abs(-gap.sum() + 0.1 * own["base"]) < 1e-6


def test_search_skips_far_cells_and_stays_exact(spark, monkeypatch):
    """Clustered vectors in small segments, several query states and scans; ties at the k-th place."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 6)) * 5
    v = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 6)) / 10).astype(np.float32)
    v[100:130] = v[7]
    q = np.vstack([centres + 0.1, rng.normal(size=(15, 6)), v[7:8].astype(float)])
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "c int, embedding array<double>")
    vs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "instance_idx bigint, embedding array<float>").repartition(3)
    sims = np.round(q @ v.astype(float).T, 12)
    want = {(i, r, int(j)) for i, s in enumerate(sims) for r, j in enumerate(np.lexsort((np.arange(len(v)), -s))[:9])}
    for segment, state, block in ((1 << 27, 1 << 28, 1 << 28), (20_000, 16 * 4114 * 10, 1 << 28), (20_000, 1 << 28, 700)):
        monkeypatch.setattr(similarity, "SEGMENT_BYTES", segment)
        monkeypatch.setattr(similarity, "STATE_BYTES", state)
        found = similarity.top_k(qs, vs, 9, query_keys=["c"], block_bytes=block)
        assert {(r["c"], r["rank_idx"], r["instance_idx"]) for r in found.collect()} == want
    monkeypatch.setattr(similarity, "SEGMENT_BYTES", 1 << 27)
    share = similarity.scored_share(qs, vs, 9, query_keys=["c"]).first()
    assert share["pairs"] == len(q) * len(v) and share["scored"] < share["pairs"] / 2


def test_many_queries_share_one_scan(spark, tmp_path):
    rng = np.random.default_rng(10)
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(50, 4)))], "instance_idx bigint, embedding array<double>").write.parquet(f"{tmp_path}/v")
    qs = spark.createDataFrame(pd.DataFrame({"c": range(20_000), "embedding": [x.tolist() for x in rng.normal(size=(20_000, 4))]}))
    out = similarity.top_k(qs, spark.read.parquet(f"{tmp_path}/v"), 3, query_keys=["c"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert out.count() == 60_000
