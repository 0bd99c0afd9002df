"""Queries on category vectors and exact top-k retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similarity, vectors
from .registry import query

K = 10

_CENTROIDS = """
    WITH parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM {embeddings}),
    means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM parts GROUP BY ALL),
    norms AS (SELECT label, sqrt(sum(m * m)) AS n FROM means GROUP BY ALL),
    cats AS (SELECT label, list(m / n ORDER BY i) AS v FROM means JOIN norms USING (label) GROUP BY ALL)
"""


def _pooled(t):
    return vectors.mean_pool(t.embeddings, ["label"])


def category_vectors(t):
    return _pooled(t).select("label", vectors.normalised("embedding").alias("embedding"))


def _spread(df, key="label"):
    return df.select(key, F.posexplode("embedding").alias("pos", "x")).select(
        key, F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + F.lit(0.0)).alias("x")
    )


@query("category_centroids", """
    WITH parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM {embeddings})
    SELECT label, CAST(i - 1 AS BIGINT) AS pos, round(avg(CAST(x AS DOUBLE)), 6) + 0.0 AS x FROM parts GROUP BY ALL""")
def category_centroids(t):
    return _spread(_pooled(t))


@query("ensemble_normalise", """
    WITH parts AS (SELECT label, vec_id % 2 AS side, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM {embeddings}),
    means AS (SELECT label, side, i, avg(CAST(x AS DOUBLE)) AS m FROM parts GROUP BY ALL),
    mixed AS (SELECT label, i, sum(m) / 2 AS m FROM means GROUP BY ALL HAVING count(*) = 2),
    norms AS (SELECT label, sqrt(sum(m * m)) AS n FROM mixed GROUP BY ALL)
    SELECT label, CAST(i - 1 AS BIGINT) AS pos, round(m / n, 6) + 0.0 AS x FROM mixed JOIN norms USING (label)""")
def ensemble_normalise(t):
    """Two embedding methods per category, averaged and brought to unit length."""
    even = vectors.mean_pool(t.embeddings.filter("vec_id % 2 = 0"), ["label"])
    odd = vectors.mean_pool(t.embeddings.filter("vec_id % 2 = 1"), ["label"])
    both = even.select("label", F.col("embedding").alias("a")).join(
        odd.select("label", F.col("embedding").alias("b")), "label"
    )
    return _spread(both.select("label", vectors.ensemble("a", "b").alias("embedding")))


_RANKED = """,
    sims AS (SELECT c.label, e.vec_id AS instance_idx, list_dot_product(CAST(e.embedding AS DOUBLE[]), c.v) AS sim
             FROM cats c CROSS JOIN {embeddings} e WHERE TRUE),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sim, 12) DESC, instance_idx) - 1 AS rank_idx FROM sims)
    SELECT label, instance_idx, rank_idx, round(sim, 6) AS sim FROM ranked WHERE rank_idx < 10"""


def _top_k(t, corpus, **kwargs):
    found = similarity.top_k(
        category_vectors(t), corpus, K, query_keys=["label"], vector_id="vec_id", **kwargs
    )
    return found.withColumn("sim", F.round("sim", 6)).withColumn("rank_idx", F.col("rank_idx").cast("long"))


@query("topk_similarity", _CENTROIDS + _RANKED)
def topk_similarity(t):
    return _top_k(t, t.embeddings)


@query("topk_restricted", _CENTROIDS + _RANKED.replace("WHERE TRUE", "WHERE e.label < 5"))
def topk_restricted(t):
    """Only some datasets are searched."""
    return _top_k(t, t.embeddings.filter("label < 5"))


@query("topk_shard_merge", _CENTROIDS + _RANKED)
def topk_shard_merge(t):
    """Queries in several broadcast blocks over a corpus in several partitions."""
    return _top_k(t, t.embeddings.repartition(7, "vec_id"), block_bytes=2048)


def _apart(df):
    """Vectors with six dimensions more, in which the labels lie apart."""
    more = [F.when(F.col("label") % 6 == k, 5.0).otherwise(0.0) for k in range(6)]
    return df.withColumn("embedding", F.concat(F.col("embedding").cast("array<double>"), F.array(*more)))


@query("topk_apart", _CENTROIDS + """,
    sims AS (SELECT c.label, e.vec_id AS instance_idx,
                    list_dot_product(CAST(e.embedding AS DOUBLE[]), c.v) + CASE WHEN c.label % 6 = e.label % 6 THEN 25 ELSE 0 END AS sim
             FROM cats c CROSS JOIN {embeddings} e),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sim, 12) DESC, instance_idx) - 1 AS rank_idx FROM sims)
    SELECT label, instance_idx, rank_idx, round(sim, 6) AS sim FROM ranked WHERE rank_idx < 3""")
def topk_apart(t):
    """Search in vectors whose labels lie apart, where most cells are skipped."""
    found = similarity.top_k(_apart(category_vectors(t)), _apart(t.embeddings), 3, query_keys=["label"], vector_id="vec_id")
    return found.withColumn("sim", F.round("sim", 6)).withColumn("rank_idx", F.col("rank_idx").cast("long"))


@query("topk_scored_share", "SELECT true AS some_skipped, (SELECT count(DISTINCT label) FROM {embeddings}) * count(*) AS pairs FROM {embeddings}")
def topk_scored_share(t):
    """Of how many pairs the same search skips some."""
    share = similarity.scored_share(_apart(category_vectors(t)), _apart(t.embeddings), 3, query_keys=["label"], vector_id="vec_id")
    return share.select((F.col("scored") < F.col("pairs")).alias("some_skipped"), "pairs")


@query("category_text", """
    SELECT p_partkey, 'Task: ' || p_name || chr(10) || 'Occupation: ' || p_brand AS headings,
           p_name || chr(10) || p_brand AS plain FROM {part}""")
def category_text(t):
    return t.part.select(
        "p_partkey", vectors.category_text("p_name", "p_brand").alias("headings"),
        vectors.category_text("p_name", "p_brand", "concat").alias("plain"),
    )


@query("truncate_to_tokens", r"""
    SELECT doc_id, regexp_extract(text, '(?s)^([ \t\n\r\f\v]*(?:[^ \t\n\r\f\v]+[ \t\n\r\f\v]*){0,64})', 1) AS head FROM {documents}""")
def truncate_to_tokens(t):
    return t.documents.select("doc_id", vectors.truncate_tokens("text", 64).alias("head"))


@query("sample_dwas", """
    WITH chosen AS (SELECT DISTINCT dwa_id FROM {task_dwa} ORDER BY md5('6|' || dwa_id), dwa_id LIMIT 20)
    SELECT title, task, dwa_id, dwa_title FROM {task_dwa} WHERE dwa_id IN (SELECT dwa_id FROM chosen)""")
def sample_dwas(t):
    return vectors.sample_dwas(t.task_dwa, 20, seed=6, dwa="dwa_id")


@query("attach_iwa", """
    SELECT e.title, e.task, e.dwa_id, e.dwa_title, i.iwa_title FROM {task_dwa} e LEFT JOIN {dwa_iwa} i
    ON e.dwa_id = i.dwa_id AND e.dwa_title = i.dwa_title""")
def attach_iwa(t):
    return vectors.attach_iwa(t.task_dwa, t.dwa_iwa, ["dwa_id", "dwa_title"])
