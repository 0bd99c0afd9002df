"""Queries on predictions, judging, leaderboards and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conversation as C
from ..functions import labels as L
from ..operators import comparison as M
from ..operators import conversations as convo_ops
from ..operators import judging as J
from ..operators import pairwise as W
from ..operators import predictions as P
from ..session import materialised
from .registry import query

# ---- predictions -------------------------------------------------------------


def _category_pairs(t):
    return t.events.select("event_id", F.col("user_id").alias("instance_idx"), (F.col("user_id") % 60).alias("category_idx"))


_SAMPLE = """
    WITH p AS (SELECT event_id, user_id AS instance_idx, user_id % 60 AS category_idx FROM {events}),
    r AS (SELECT *, row_number() OVER (PARTITION BY category_idx ORDER BY md5('0|' || category_idx || '|' || event_id), event_id) AS i,
                 count(*) OVER (PARTITION BY category_idx) AS n FROM p)
"""


@query("stratified_sample", _SAMPLE + "SELECT event_id, instance_idx, category_idx FROM r WHERE i <= 50 AND n >= 50")
def stratified_sample(t):
    return P.stratified_sample(_category_pairs(t), keys=["event_id"], n=50)


@query("stratified_sample_keep", _SAMPLE + "SELECT event_id, instance_idx, category_idx FROM r WHERE i <= 190")
def stratified_sample_keep(t):
    """Deficient categories are kept whole."""
    return P.stratified_sample(_category_pairs(t), keys=["event_id"], n=190, drop_deficient=False)


@query("stratified_sample_dedupe", """
    WITH p AS (SELECT event_id, user_id % 60 AS category_idx, event_type FROM {events}),
    o AS (SELECT category_idx, event_type, min(event_id) AS event_id FROM p GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY category_idx ORDER BY md5('0|' || category_idx || '|' || event_id), event_id) AS i,
                 count(*) OVER (PARTITION BY category_idx) AS n FROM o)
    SELECT event_id, category_idx FROM r WHERE i <= 3 AND n >= 3""")
def stratified_sample_dedupe(t):
    rows = t.events.select(
        "event_id", (F.col("user_id") % 60).alias("category_idx"),
        F.array(C.turn("user", F.col("event_type"))).alias("convo_subset"),
    )
    return P.stratified_sample_dedupe(rows, keys=["event_id"], n=3).select("event_id", "category_idx")


def _merged(t, strict=False):
    convos = convo_ops.from_turns(t.turns).select(
        F.col("conv_id").alias("idx"), (F.col("conv_id") % 10).alias("category_idx"),
        F.concat(F.lit("dwa "), (F.col("conv_id") % 10).cast("string")).alias("dwa"),
        F.col("convo").alias("convo_subset"),
    )
    good = F.when(F.col("idx") % 7 > 0, C.fingerprint("convo_subset")).otherwise(F.lit("stale"))
    hashes = convos.select("idx", good.alias("convo_hash"))
    preds = t.events.select(F.col("user_id").alias("idx"), F.col("event_type").alias("model"), "event_id").groupBy("idx", "model").agg(
        F.min("event_id").alias("e")
    ).join(hashes, "idx").select(
        "idx", "model", "convo_hash",
        F.when(F.col("e") % 4 > 0, F.concat(F.lit("answer "), F.col("e").cast("string"))).alias("response"),
        F.when(F.col("e") % 4 == 0, F.lit("timeout")).alias("error"),
    )
    return P.export_join(convos, preds, strict=strict), preds


_PREDS = """
    WITH k AS (SELECT DISTINCT conv_id FROM {turns}),
    p AS (SELECT user_id AS idx, event_type AS model, min(event_id) AS e FROM {events} WHERE user_id IN (SELECT conv_id FROM k) GROUP BY ALL)
"""


@query("export_join", _PREDS + """
    SELECT idx, model, idx % 10 AS category_idx, CASE WHEN e % 4 > 0 THEN 'answer ' || e ELSE 'Server error' END AS response,
           CASE WHEN e % 4 = 0 THEN 'timeout' END AS error FROM p WHERE idx % 7 > 0""")
def export_join(t):
    merged, _ = _merged(t)
    return merged.select("idx", "model", "category_idx", "response", "error")


@query("export_answers", _PREDS + """
    SELECT CAST(idx AS VARCHAR) AS uid, model || '-' || idx AS ans_id, model,
           string_agg(CASE role WHEN 'user' THEN 'Human: ' ELSE 'Assistant: ' END || text, chr(10) || chr(10) ORDER BY turn)
           || chr(10) || chr(10) || 'Assistant: ' || CASE WHEN any_value(e) % 4 > 0 THEN 'answer ' || any_value(e) ELSE 'Server error' END AS messages
    FROM p JOIN {turns} ON idx = conv_id WHERE idx % 7 > 0 GROUP BY idx, model""")
def export_answers(t):
    merged, _ = _merged(t)
    return P.answers(merged).select("uid", "ans_id", "model", C.render("messages").alias("messages"))


@query("export_questions", _PREDS + """
    SELECT DISTINCT CAST(idx AS VARCHAR) AS uid, 'ei' AS category, CAST(idx % 10 AS VARCHAR) AS subcategory FROM p WHERE idx % 7 > 0""")
def export_questions(t):
    merged, _ = _merged(t)
    return P.questions(merged).select("uid", "category", "subcategory").distinct()


@query("prediction_errors", _PREDS + """
    SELECT model, count(*) AS n, count(*) FILTER (e % 4 = 0) AS n_errors FROM p GROUP BY ALL""")
def prediction_errors(t):
    return P.error_counts(_merged(t)[1])


@query("category_first", """
    SELECT c_nationkey AS subcategory_idx, arg_min(c_name, c_custkey) AS subcategory_name FROM {customer} GROUP BY 1""")
def category_first(t):
    rows = t.customer.select(
        F.col("c_custkey").alias("idx"), F.col("c_nationkey").alias("category_idx"), F.col("c_name").alias("dwa")
    )
    return P.category_first(rows)


@query("prediction_rows", """
    SELECT doc_id AS idx, sha256('[{"content":' || to_json(text) || ',"role":"user"}]') AS convo_hash,
           CASE WHEN doc_id % 3 > 0 THEN lang END AS response, CASE WHEN doc_id % 3 = 0 THEN 'no response' END AS error FROM {documents}""")
def prediction_rows(t):
    rows = t.documents.select(
        F.col("doc_id").alias("idx"), F.array(C.turn("user", F.col("text"))).alias("convo_subset"),
        F.lit("h").alias("request_hash"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("output"),
        F.lit(None).cast("string").alias("error"),
    )
    return P.prediction_rows(rows).drop("request_hash")


# ---- judging -----------------------------------------------------------------

_ANS = """
    qs AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) || chr(10) ORDER BY turn) FILTER (turn < last) AS history,
                  max(text) FILTER (turn = last) AS question
           FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM {turns}) GROUP BY 1),
    ans AS (SELECT DISTINCT conv_id, 'm' || event_id % 4 AS model FROM {events} JOIN qs ON user_id = conv_id WHERE event_id % 11 > 0),
    basis AS (SELECT conv_id FROM qs)
"""


def _questions(t):
    return convo_ops.from_turns(t.turns).select(
        F.col("conv_id").cast("string").alias("uid"), F.lit("ei").alias("category"), "convo"
    )


def _judge_inputs(t):
    q = _questions(t)
    given = t.events.filter("event_id % 11 > 0").select(
        F.col("user_id").cast("string").alias("uid"),
        F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")).alias("model"),
    ).distinct()
    base = q.select("uid", F.lit("base").alias("model"))
    answers = given.unionByName(base).join(q.select("uid", "convo"), "uid").select(
        "uid", "model", C.append_answer("convo", F.concat(F.lit("by "), F.col("model"))).alias("messages")
    )
    return J.judge_inputs(q, answers, "base")


_TEMPLATE = "{CONVERSATION_HISTORY}\n##\n{QUESTION}\n[A]{ANSWER_A}[B]{ANSWER_B}"


@query("judge_inputs", "WITH " + _ANS + """
    SELECT CAST(conv_id AS VARCHAR) AS uid, model, g AS game, 'be fair' AS system,
           coalesce(history, '') || chr(10) || '##' || chr(10) || question || chr(10) || '[A]by ' || CASE g WHEN 0 THEN 'base' ELSE model END
           || '[B]by ' || CASE g WHEN 0 THEN model ELSE 'base' END AS prompt
    FROM ans JOIN qs USING (conv_id), (SELECT unnest([0, 1]) AS g)""")
def judge_inputs(t):
    """Both games of every question and model, with history, question and answers."""
    prompts = J.judge_prompts(_judge_inputs(t), template=_TEMPLATE, system={"ei": "be fair"})
    return prompts.select(
        "uid", "model", "game", F.get("prompt", F.lit(0))["content"].alias("system"),
        F.get("prompt", F.lit(1))["content"].alias("prompt"),
    )


@query("judge_games", "WITH " + _ANS + """,
    o AS (SELECT CAST(conv_id AS VARCHAR) AS uid, model, conv_id % 3 AS a, conv_id % 5 AS b FROM ans)
    SELECT uid, model, CASE a WHEN 0 THEN 'A>>B' WHEN 1 THEN 'B>A' END AS game1, CASE b WHEN 0 THEN NULL ELSE 'A=B' END AS game2, a = 2 AS missing1 FROM o""")
def judge_games(t):
    """Outputs of both games collated; a missing output is a null game."""
    inputs = J.judge_prompts(_judge_inputs(t), template=_TEMPLATE, system={"ei": "be fair"})
    uid = F.col("uid").cast("long")
    first = F.when(uid % 3 == 0, "so [[a>>b]]").when(uid % 3 == 1, "[A=B] but [[B>A]]")
    second = F.when(uid % 5 == 0, "no verdict").otherwise("[[]] [A=B]")
    outputs = inputs.withColumn("output", F.when(F.col("game") == 0, first).otherwise(second))
    games = J.game_scores(J.games_from_outputs(outputs, judge="j"))
    return games.select(
        "uid", "model", "game1", "game2", F.get("games", F.lit(0)).isNull().alias("missing1")
    )


_W = """
    v AS (SELECT * FROM (VALUES ('A>B', [1.0]), ('A>>B', [1.0, 1.0, 1.0]), ('A=B', [0.5]), ('B>A', [0.0]), ('B>>A', [0.0, 0.0, 0.0])) x(k, s)),
    sc AS (SELECT j.*, v2.s AS fwd, [1.0 - x FOR x IN v1.s] AS rev FROM {judgments} j JOIN v v1 ON game1 = v1.k JOIN v v2 ON game2 = v2.k),
    bt AS (SELECT event_id, uid, model, subcategory_idx, CAST(unnest(fwd || rev) AS DOUBLE) AS scores FROM sc)
"""


@query("battles", "WITH " + _W + "SELECT event_id, uid, model, subcategory_idx, scores FROM bt")
def battles(t):
    return J.battles(t.judgments).select("event_id", "uid", "model", "subcategory_idx", "scores")


@query("subcategory_join", "WITH " + _W + """
    SELECT event_id, subcategory_idx, n_name AS subcategory_name FROM {judgments} JOIN {nation} ON subcategory_idx = n_nationkey""")
def subcategory_join(t):
    questions = t.events.select(
        F.col("user_id").cast("string").alias("uid"), (F.col("user_id") % 10).cast("string").alias("subcategory")
    ).distinct()
    names = t.nation.select(F.col("n_nationkey").alias("subcategory_idx"), F.col("n_name").alias("subcategory_name"))
    out = J.attach_subcategory(t.judgments.drop("subcategory_idx"), questions, names)
    return out.select("event_id", F.col("subcategory_idx").cast("long").alias("subcategory_idx"), "subcategory_name")


_STRATA = """,
    st AS (SELECT CAST(subcategory_idx AS VARCHAR) AS stratum, model, scores FROM bt UNION ALL SELECT 'ALL', model, scores FROM bt),
    mean AS (SELECT stratum, model, avg(scores) AS score, count(*) AS n_battles FROM st GROUP BY ALL)
"""


def _cells(t):
    judged = t.judgments.withColumn("stratum", F.col("subcategory_idx"))
    return J.with_all_stratum(J.cells_from_judgments(judged, ["stratum"]), "stratum")


@query("leaderboard_means", "WITH " + _W + _STRATA + "SELECT stratum, model, round(score, 6) AS score, n_battles FROM mean")
def leaderboard_means(t):
    """Means per stratum and over all, in one pass over verdict counts."""
    out = J.means(_cells(t), ["stratum"])
    return out.select("stratum", "model", F.round("score", 6).alias("score"), "n_battles")


@query("score_summary", "WITH " + _W + """
    SELECT event_id, CAST(list_sum(fwd) AS DOUBLE) AS forward_score, CAST(list_sum(rev) AS DOUBLE) AS backward_score,
           CAST((list_sum(fwd) + list_sum(rev)) / 2 AS DOUBLE) AS avg FROM sc""")
def score_summary(t):
    out = J.score_summary(J.with_scores(t.judgments))
    return out.select("event_id", "forward_score", "backward_score", "avg")


@query("grid_complete", "WITH " + _W + """,
    u AS (SELECT DISTINCT uid FROM {judgments}), m AS (SELECT DISTINCT model FROM {judgments}),
    f AS (SELECT uid, model, min(event_id) AS event_id FROM sc WHERE event_id % 2 = 0 GROUP BY ALL)
    SELECT uid, model, event_id FROM u CROSS JOIN m LEFT JOIN f USING (uid, model)""")
def grid_complete(t):
    scored = J.with_scores(t.judgments.filter("event_id % 2 = 0"))
    first = J.once_per_answer(scored, ["event_id"]).select("uid", "model", "event_id")
    return J.fill_grid(first, t.judgments.select("uid"), t.judgments.select("model"))


@query("leaderboard_doc_counts", "WITH " + _W + """,
    u AS (SELECT DISTINCT uid FROM sc), m AS (SELECT DISTINCT model FROM sc),
    f AS (SELECT uid, model, arg_min((list_sum(fwd) + list_sum(rev)) / 2, event_id) AS avg FROM sc GROUP BY ALL)
    SELECT model, (uid_rank // 20) AS page, count(*) AS n_entries, count(avg) AS n_judged, round(CAST(sum(avg) AS DOUBLE), 6) AS total
    FROM (SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS uid_rank FROM u) CROSS JOIN m LEFT JOIN f USING (uid, model) GROUP BY ALL""")
def leaderboard_doc_counts(t):
    """Entries of the leaderboard document per model and block of twenty questions."""
    from ..plans import leaderboards

    entries = leaderboards.document_entries(J.with_scores(t.judgments), order=["event_id"])
    return entries.groupBy("model", F.floor(F.col("question_idx") / 20).alias("page")).agg(
        F.count(F.lit(1)).alias("n_entries"), F.count("avg").alias("n_judged"),
        F.round(F.sum("avg"), 6).alias("total"),
    )


@query("bootstrap_ci", "WITH " + _W + _STRATA + """
    SELECT stratum, model, n_battles, round(score, 6) AS exact, true AS mean_near, true AS width_near, true AS ordered FROM mean""")
def bootstrap_ci(t):
    """Exact multinomial bootstrap per stratum and model, held against theory.

    The mean of 400 replicates has to lie within five of its standard errors of
    the exact mean, and the half-width within 25 % of 1.645 standard errors.
    """
    cells = _cells(t)
    found = J.replicate_summary(J.bootstrap_means(cells, ["stratum"], n_bootstrap=400), ["stratum"])
    exact = cells.groupBy("stratum", "model").agg(
        F.sum("n").alias("n_battles"), (F.sum(F.col("scores") * F.col("n")) / F.sum("n")).alias("exact"),
        (F.sum(F.col("scores") * F.col("scores") * F.col("n")) / F.sum("n")).alias("square"),
    )
    error = F.sqrt(F.greatest(F.col("square") - F.col("exact") * F.col("exact"), F.lit(0.0)) / F.col("n_battles"))
    half = (F.col("upper") - F.col("lower")) / 2
    return found.join(exact, ["stratum", "model"]).select(
        "stratum", "model", "n_battles", F.round("exact", 6).alias("exact"),
        (F.abs(F.col("score") - F.col("exact")) <= 0.25 * error + 1e-9).alias("mean_near"),
        (F.abs(half - 1.645 * error) <= 0.25 * 1.645 * error + 1e-9).alias("width_near"),
        ((F.col("lower") <= F.col("score")) & (F.col("score") <= F.col("upper"))).alias("ordered"),
    )


@query("leaderboard", """
    WITH s AS (SELECT 'u' || user_id % 10 AS stratum, event_type AS model, avg(value) AS m,
                      quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM {events} GROUP BY ALL),
    r AS (SELECT stratum, model, round(CAST(m * 100 AS DECIMAL(38, 10)), 1) AS score,
                 '(-' || CAST(round(CAST((m - lo) * 100 AS DECIMAL(38, 10)), 1) AS DECIMAL(20, 1)) || ' / +' || CAST(round(CAST((hi - m) * 100 AS DECIMAL(38, 10)), 1) AS DECIMAL(20, 1)) || ')' AS ci FROM s)
    SELECT stratum, model, CAST(score AS DOUBLE) AS score, ci FROM r
    UNION ALL SELECT DISTINCT stratum, 'm0', 50.0, '(-0.0 / +0.0)' FROM r""")
def leaderboard(t):
    """Display leaderboards per stratum with interval text and baseline row.

    The values of the events are the replicates, so that SQL has the same ones.
    """
    replicates = t.events.select(
        F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("stratum"),
        F.col("event_type").alias("model"), F.col("value").alias("mean"),
    )
    return J.leaderboard(J.replicate_summary(replicates, ["stratum"]), ["stratum"], baseline="m0")


@query("bt_coefficients", "WITH " + _W + _STRATA + """
    SELECT stratum, model, round(ln(score / (1 - score)), 6) + 0.0 AS coef, round(score, 6) AS p FROM mean""")
def bt_coefficients(t):
    out = W.coefficients(_cells(t), ["stratum"])
    return out.select(
        "stratum", "model", (F.round("coef", 6) + F.lit(0.0)).alias("coef"),
        F.round(W.win_probability(F.col("coef")), 6).alias("p"),
    )


@query("rao_kupper", "WITH " + _W + _STRATA + """
    SELECT stratum, model, CAST(0 AS DOUBLE) AS gradient, true AS converged, true AS ordered FROM mean""")
def rao_kupper(t):
    """Tie model with 100 replicates: the fit is stationary, its quantiles are in order."""
    cells = _cells(t)
    fits = materialised(W.tie_model(cells, ["stratum"], n_bootstrap=100))
    probability = fits.filter("replicate > 0").withColumn("p", W.win_probability(F.col("coef")))
    found = J.replicate_summary(probability, ["stratum"], value="p", centre="median")
    done = fits.groupBy("stratum", "model").agg(F.bool_and("converged").alias("converged"))
    on = ["stratum", "model"]
    return W.tie_gradient(cells, fits, ["stratum"]).join(found, on).join(done, on).select(
        *on, (F.round("gradient", 4) + F.lit(0.0)).alias("gradient"), "converged",
        ((F.col("lower") <= F.col("score")) & (F.col("score") <= F.col("upper"))).alias("ordered"),
    )


_STYLE = """
    bs AS (SELECT event_id, uid, model, scores FROM bt WHERE model <> 'm0'),
    md AS (SELECT uid, 'm' || m AS model, CAST((uid * 37 + m * 101) % 900 + 100 AS DOUBLE) AS length, CAST((uid * 7 + m * 3) % 20 AS DOUBLE) AS headers,
                  CAST((uid * 11 + m * 5) % 17 AS DOUBLE) AS lists FROM (SELECT DISTINCT uid FROM {judgments}), (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS m)),
    raw AS (SELECT bs.*, (a.length - b.length) / (a.length + b.length) AS f0,
                   (a.headers / (a.length + 1) - b.headers / (b.length + 1)) / (a.headers / (a.length + 1) + b.headers / (b.length + 1) + 1) AS f1,
                   (a.lists / (a.length + 1) - b.lists / (b.length + 1)) / (a.lists / (a.length + 1) + b.lists / (b.length + 1) + 1) AS f2
            FROM bs JOIN md a ON bs.uid = a.uid AND bs.model = a.model JOIN md b ON bs.uid = b.uid AND b.model = 'm0'),
    st AS (SELECT avg(f0) AS a0, stddev_samp(f0) AS s0, avg(f1) AS a1, stddev_samp(f1) AS s1, avg(f2) AS a2, stddev_samp(f2) AS s2 FROM raw)
"""


def _style_inputs(t):
    rows = J.battles(t.judgments).filter("model <> 'm0'").select("event_id", "uid", "model", "scores")
    models = t.judgments.select("uid").distinct().withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(6))))
    meta = models.select(
        "uid", F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"),
        ((F.col("uid") * 37 + F.col("m") * 101) % 900 + 100).alias("length"),
        ((F.col("uid") * 7 + F.col("m") * 3) % 20).alias("headers"),
        ((F.col("uid") * 11 + F.col("m") * 5) % 17).alias("lists"),
    )
    return rows, meta, ["headers", "lists"]


@query("style_features", "WITH " + _W + "," + _STYLE + """
    SELECT event_id, uid, model, scores, round((f0 - a0) / s0, 6) + 0.0 AS f_length, round((f1 - a1) / s1, 6) + 0.0 AS f_headers, round((f2 - a2) / s2, 6) + 0.0 AS f_lists
    FROM raw, st""")
def style_features(t):
    """Standardised style differences per battle."""
    rows, meta, counts = _style_inputs(t)
    out = W.style_features(rows, meta, "m0", counts)
    return out.select(
        "event_id", "uid", "model", "scores",
        *[(F.round(f"f_{c}", 6) + F.lit(0.0)).alias(f"f_{c}") for c in ("length", *counts)],
    )


@query("bt_style", """
    SELECT n AS name, CAST(0 AS DOUBLE) AS gradient, CASE WHEN n LIKE 'm%' THEN true END AS converged, CASE WHEN n LIKE 'm%' THEN true END AS ordered
    FROM (SELECT DISTINCT model AS n FROM {judgments} UNION SELECT unnest(['m0', 'f_length', 'f_headers', 'f_lists']))""")
def bt_style(t):
    """Style-controlled win probabilities with 100 exact resamples.

    The fit is stationary in every column, the quantiles of the models are in order.
    """
    rows, meta, counts = _style_inputs(t)
    featured = materialised(W.style_features(rows, meta, "m0", counts))
    features = ["f_length", *[f"f_{c}" for c in counts]]
    fits = W.style_fits(featured, features, "m0", n_bootstrap=100)
    board = W.style_leaderboard(fits, features, "m0").withColumnRenamed("model", "name")
    return W.style_gradient(featured, fits, features, "m0").join(board, "name", "left").select(
        "name", (F.round("gradient", 5) + F.lit(0.0)).alias("gradient"), "converged",
        ((F.col("lower") <= F.col("score")) & (F.col("score") <= F.col("upper"))).alias("ordered"),
    )


@query("binary_bootstrap", """
    SELECT n AS name, CAST(0 AS DOUBLE) AS gradient, true AS converged, true AS ordered
    FROM (SELECT unnest(['f_length', 'f_headers', 'f_lists', 'intercept']) AS n)""")
def binary_bootstrap(t):
    """Win or not by style alone: intercept, l2 penalty of 1 and 100 exact resamples.

    The penalised fit is stationary in every coefficient, the quantiles are in order.
    """
    rows, meta, counts = _style_inputs(t)
    featured = materialised(W.style_features(rows, meta, "m0", counts))
    features = ["f_length", *[f"f_{c}" for c in counts]]
    design = featured.select(F.array(*features).alias("x"), (F.col("scores") > 0.5).cast("double").alias("y"))
    design = design.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    fits = t.spark.createDataFrame(
        W.logistic_bootstrap(design, features, n_bootstrap=100, intercept=True, l2=1.0),
        "replicate INT, name STRING, coef DOUBLE, converged BOOLEAN",
    )
    fit = {r["name"]: r["coef"] for r in fits.filter("replicate = 0").collect()}  # four coefficients
    z = F.lit(fit["intercept"])
    for f in features:
        z = z + F.col(f) * F.lit(fit[f])
    gap = 1 / (1 + F.exp(-z)) - (F.col("scores") > 0.5).cast("double")
    slopes = featured.select(gap.alias("gap"), *features, F.lit(1.0).alias("intercept")).agg(*[
        ((F.sum(F.col("gap") * F.col(c)) + F.lit(fit[c] if c != "intercept" else 0.0)) / F.count(F.lit(1))).alias(c)
        for c in [*features, "intercept"]
    ])
    long = slopes.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("g")) for c in slopes.columns])).alias("s"))
    ranges = fits.filter("replicate > 0").groupBy("name").agg(
        F.percentile("coef", F.lit(0.5)).alias("score"), F.percentile("coef", F.lit(0.05)).alias("lower"),
        F.percentile("coef", F.lit(0.95)).alias("upper"), F.bool_and("converged").alias("converged"),
    )
    return long.select("s.name", "s.g").join(ranges, "name").select(
        "name", (F.round("g", 6) + F.lit(0.0)).alias("gradient"), "converged",
        ((F.col("lower") < F.col("score")) & (F.col("score") < F.col("upper"))).alias("ordered"),
    )


@query("style_metadata", """
    SELECT event_id, CAST(event_id % 900 + 100 AS DOUBLE) AS token_len, CAST(event_id % 4 + event_id % 3 AS DOUBLE) AS header_count,
           CAST(CASE WHEN event_id % 10 = 0 THEN 0 ELSE event_id % 7 END AS DOUBLE) AS bold_count
    FROM {judgments}""")
def style_metadata(t):
    """Numbers out of an answer's metadata: plain ones and sums over maps of counts."""
    e = F.col("event_id")
    metadata = F.create_map(
        F.lit("token_len"), (e % 900 + 100).cast("string"),
        F.lit("header_count"), F.format_string('{"h1": %d, "h2": %d}', e % 4, e % 3),
        F.lit("bold_count"), F.when(e % 10 == 0, F.lit("{}")).otherwise(F.format_string('{"**": %d, "__": 0}', e % 7)),
    )
    rows = t.judgments.select("event_id", metadata.alias("metadata"))
    return rows.select("event_id", *W.metadata_counts(F.col("metadata"), ["token_len", "header_count", "bold_count"]))


# ---- comparisons -------------------------------------------------------------

# leaderboards: a nation per board, a segment per model
_LB = """
    lb AS (SELECT 'lb' || c_nationkey AS lb_id, c_mktsegment AS model,
                  CASE WHEN count(*) % 13 > 0 THEN round(avg(c_acctbal), 2) END AS score, min(c_custkey) AS pos, c_nationkey AS idx
           FROM {customer} GROUP BY c_nationkey, c_mktsegment),
    rk AS (SELECT *, row_number() OVER (PARTITION BY lb_id ORDER BY score DESC, pos) AS rank FROM lb WHERE score IS NOT NULL)"""
_CHOSEN = "('BUILDING', 'MACHINERY', 'HOUSEHOLD')"


def boards(t):
    return t.customer.groupBy("c_nationkey", F.col("c_mktsegment").alias("model")).agg(
        F.when(F.count(F.lit(1)) % 13 > 0, F.round(F.avg("c_acctbal"), 2)).alias("score"),
        F.min("c_custkey").alias("pos"),
    ).select(
        F.concat(F.lit("lb"), F.col("c_nationkey").cast("string")).alias("lb_id"), "model", "score", "pos",
        F.col("c_nationkey").alias("idx"),
    )


def _models(t):
    return t.customer.filter("c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')").select(
        F.col("c_mktsegment").alias("model")
    )


@query("lb_ranks", "WITH " + _LB + "SELECT lb_id, model, score, rank FROM rk")
def lb_ranks(t):
    return M.ranks(boards(t)).select("lb_id", "model", "score", "rank")


@query("lb_range_mean", "WITH " + _LB + f"""
    SELECT lb_id, round(max(score) - min(score), 6) AS "range", round(avg(score), 6) AS mean FROM rk WHERE model IN {_CHOSEN} GROUP BY ALL""")
def lb_range_mean(t):
    out = M.spread(M.valid_rows(boards(t)), "score", _models(t))
    return out.select("lb_id", F.round("range", 6).alias("range"), F.round("mean", 6).alias("mean"))


@query("lb_rank_range_mean", "WITH " + _LB + f"""
    SELECT lb_id, max(rank) - min(rank) AS "range", round(avg(rank), 6) AS mean FROM rk WHERE model IN {_CHOSEN} GROUP BY ALL""")
def lb_rank_range_mean(t):
    out = M.spread(M.ranks(boards(t)), "rank", _models(t))
    return out.select("lb_id", "range", F.round("mean", 6).alias("mean"))


_DIFF = _LB + f""",
    d AS (SELECT a.lb_id, CAST(sum(abs(a.rank - b.rank)) AS DOUBLE) AS diff FROM rk a JOIN rk b ON a.model = b.model AND b.lb_id = 'lb3'
          WHERE a.model IN {_CHOSEN} GROUP BY 1),
    df AS (SELECT k.lb_id, k.idx, coalesce(diff, CAST('inf' AS DOUBLE)) AS diff FROM (SELECT DISTINCT lb_id, idx FROM rk) k LEFT JOIN d USING (lb_id))"""


@query("lb_rank_diff", "WITH " + _DIFF + " SELECT lb_id, CAST(diff AS VARCHAR) AS diff FROM df")
def lb_rank_diff(t):
    out = M.rank_difference(M.ranks(boards(t)), "lb3", _models(t))
    return out.select("lb_id", F.when(F.col("diff") == float("inf"), "inf").otherwise(F.col("diff").cast("string")).alias("diff"))


@query("lb_tile_order", "WITH " + _DIFF + " SELECT lb_id, row_number() OVER (ORDER BY diff, idx) - 1 AS place FROM df")
def lb_tile_order(t):
    board = boards(t)
    diff = M.rank_difference(M.ranks(board), "lb3", _models(t))
    tiles = diff.join(board.select("lb_id", "idx").distinct(), "lb_id")
    return M.tile_order(tiles, "diff", descending=False).select("lb_id", "place")


@query("lb_group_members", "WITH " + _LB + """
    SELECT 'g' || idx % 4 AS group_id, lb_id, row_number() OVER (PARTITION BY idx % 4 ORDER BY idx) - 1 AS pos FROM (SELECT DISTINCT lb_id, idx FROM lb)""")
def lb_group_members(t):
    manifest = boards(t).select("lb_id", "idx").distinct()
    groups = manifest.groupBy(F.concat(F.lit("g"), (F.col("idx") % 4).cast("string")).alias("group_id")).agg(
        F.collect_set("lb_id").alias("members")
    )
    return M.group_members(groups, manifest).select("group_id", "lb_id", "pos")


@query("comparison_summary", """
    WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber || '/' || l_partkey || '/' || l_suppkey AS sample, max(l_discount * 10) AS score FROM {lineitem} GROUP BY ALL)
    SELECT l_orderkey AS hypothesis, round(avg(score), 6) AS mu, coalesce(string_agg(sample, ',' ORDER BY sample) FILTER (score > 0.6), '') AS samples FROM l GROUP BY 1""")
def comparison_summary(t):
    """A hypothesis per order, its lines are the samples."""
    sample = F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey").alias("sample")
    lines = t.lineitem.groupBy("l_orderkey", sample).agg(F.max(F.col("l_discount") * 10).alias("score"))
    per = lines.groupBy(F.col("l_orderkey").alias("hypothesis")).agg(
        F.round(F.avg("score"), 6).alias("mu"),
        F.map_from_entries(F.collect_list(F.struct("sample", "score"))).alias("sample2score"),
    )
    return M.comparison_summary(per).select("hypothesis", "mu", F.array_join("samples", ",").alias("samples"))
