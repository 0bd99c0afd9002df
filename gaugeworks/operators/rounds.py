"""Rounds of filtering over (category, conversation) pairs, and turn selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import conversation as C
from ..functions import labels as L
from ..session import materialised
from .scale import GROUP_LIMIT as _GROUP_LIMIT
from .scale import dense_ids, distinct_texts, first_per_key, positions, skew_join, stable_order

PAIR_KEY = ["category_task", "category_occ", "dwa", "instance_idx"]
CATEGORY = ["category_task", "category_occ", "dwa"]


def semi_filter(df: DataFrame, *filters: DataFrame) -> DataFrame:
    """Rows whose key is in every filter table; a filter's columns are its key."""
    for f in filters:
        df = skew_join(df, f.distinct(), f.columns, "left_semi", null_equal=True)
    return df


def union_filters(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def build_filter(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def k_range(
    pairs: DataFrame,
    k_start: int,
    k_stop: int,
    *,
    keys: list[str] = CATEGORY,
    rank: str = "rank_idx",
    ties: list[str] = ("instance_idx",),
) -> DataFrame:
    """Pairs at positions k_start .. k_stop - 1 of their category by rank order.

    Gaps in the rank do not matter.  A short range is planned with a group limit
    before the exchange; a long one uses distributed positions.
    """
    order = [F.col(rank), *[F.col(t) for t in ties]]
    if k_stop <= _GROUP_LIMIT:
        w = Window.partitionBy(*keys).orderBy(*order)
        placed = pairs.withColumn("__p", F.row_number().over(w)).filter(F.col("__p") <= k_stop)
        return placed.filter(F.col("__p") > k_start).drop("__p")
    placed = positions(pairs, keys, order, "__p")
    return placed.filter((F.col("__p") >= k_start) & (F.col("__p") < k_stop)).drop("__p")


def chosen_steps(
    preds: DataFrame,
    *,
    include_only: list[str] | None = None,
    dont_include: list[str] = (),
    order: list[str] | None = None,
) -> list[str]:
    """Steps of a round after whitelist, blacklist and ordering (a handful of names)."""
    names = sorted(r[0] for r in preds.select("step").distinct().collect())
    if include_only is not None:
        names = [n for n in names if n in include_only]
    names = [n for n in names if n not in dont_include]
    return sorted(names, key=order.index) if order is not None else names


def survivors(
    pairs: DataFrame,
    preds: DataFrame,
    steps: list[str],
    *,
    keys: list[str] = PAIR_KEY,
    on_empty: str = "keep",
) -> DataFrame:
    """Pairs predicted by every step of the round and kept by all of them.

    The steps are combined by one aggregate on the pair key instead of one join
    per step.  A round without steps keeps (or drops) everything.
    """
    if not steps:
        return pairs if on_empty == "keep" else pairs.limit(0)
    kept = (
        preds.filter(F.col("step").isin(*steps) & F.col("pred_keep").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count_distinct("step").alias("__n"),
            F.bool_and("pred_keep").alias("__keep"),
        )
        .filter((F.col("__n") == len(steps)) & F.col("__keep"))
        .select(*keys)
    )
    return pairs.join(kept, keys, "left_semi")


def with_predictions(
    pairs: DataFrame, preds: DataFrame, steps: list[str], *, keys: list[str] = PAIR_KEY
) -> DataFrame:
    """Keep-all mode: a column per step and their conjunction; no row is dropped."""
    if not steps:
        return pairs
    wide = (
        preds.groupBy(*keys)
        .pivot("step", steps)
        .agg(F.first("pred_keep", ignorenulls=True))
        .select(
            *keys, *[F.col(f"`{s}`").alias(f"pred_keep_{i}") for i, s in enumerate(steps)]
        )
    )
    out = pairs.join(wide, keys, "left")
    cols = [F.col(f"pred_keep_{i}") for i in range(len(steps))]
    return out.withColumn("pred_keep_so_far", reduce(lambda a, b: a & b, cols))


def round_result(
    pairs: DataFrame, preds: DataFrame, *, keys: list[str] = PAIR_KEY, rounds: list[int]
) -> DataFrame:
    """Pairs with at least one prediction, for all rounds, with their step columns."""
    parts = []
    for r in rounds:
        one = preds.filter(F.col("round_idx") == r)
        steps = chosen_steps(one)
        if not steps:
            continue
        marked = with_predictions(pairs, one, steps, keys=keys)
        seen = F.coalesce(*[F.col(f"pred_keep_{i}") for i in range(len(steps))])
        parts.append(marked.filter(seen.isNotNull()).withColumn("round_idx", F.lit(r)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def deficient(
    pairs: DataFrame,
    kept: DataFrame,
    texts: DataFrame,
    *,
    min_samples: int = 50,
    count_column: str = "n",
    dwa: str = "dwa",
    text: str = "text",
) -> DataFrame:
    """Count of kept pairs and of distinct texts per DWA, and whether it falls short.

    ``kept`` is the union of the survivors of all rounds.  DWAs without any come
    back with zero.
    """
    # two narrow columns, needed three times: written once instead of joined again
    kept = materialised(kept.select(dwa, "instance_idx"))
    counts = kept.groupBy(dwa).agg(F.count(F.lit(1)).alias("n"))
    distinct = distinct_texts(kept.distinct(), texts, [dwa], "instance_idx", text, "n_inst_dedup")
    return (
        pairs.select(dwa)
        .distinct()
        .join(counts, dwa, "left")
        .join(distinct, dwa, "left")
        .select(
            dwa,
            F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce("n_inst_dedup", F.lit(0)).alias("n_inst_dedup"),
        )
        .withColumn("cat_keep", F.col(count_column) < min_samples)
    )


def deficient_filter(counts: DataFrame, dwa: str = "dwa") -> DataFrame:
    return counts.filter("cat_keep").select(dwa)


def category_keep(votes, method: str = "ABC") -> Column:
    return L.keep_votes(votes, L.KEEP_SETS[method])


def quality_keep(homework, flags: list[Column]) -> Column:
    """Kept when it is no homework and no quality prompt flags it."""
    low = reduce(lambda a, b: a | b, flags)
    return ~(L.homework_flag(homework) | low)


def select_turns(
    pairs: DataFrame,
    *,
    convo: str = "convo",
    answer: str = "answer",
    keys: list[str] = ("dwa", "instance_idx"),
    order: list[str] = ("category_task", "category_occ"),
) -> DataFrame:
    """Cut each pair's conversation at the picked user turn.

    One user turn needs no answer.  With several, the parsed answer must be a
    turn number; invalid answers and numbers past the end are dropped.  Repeats
    of (dwa, instance) keep the first by ``order``; the category id numbers the
    sorted DWAs.
    """
    n = C.n_user_turns(convo)
    picked = F.when(n > 1, F.col(answer).try_cast("int")).otherwise(F.lit(1))
    cut = (
        pairs.withColumn("picked_turn", picked)
        .filter(F.col("picked_turn") >= 1)
        .withColumn("convo_subset", C.prefix_to_user_turn(convo, "picked_turn"))
        .filter(F.col("convo_subset").isNotNull())
    )
    once = first_per_key(cut, list(keys), [F.col(c) for c in order])
    ids = dense_ids(cut, "dwa", "category_idx")
    return skew_join(once, ids, ["dwa"]).drop(answer)


def picked_turns(
    pairs: DataFrame,
    n: Column,
    *,
    answer: str = "answer",
    keys: list[str] = ("dwa", "instance_idx"),
    order: list[str] = ("category_task", "category_occ"),
) -> DataFrame:
    """The pairs that ``select_turns`` keeps, with their turn and category id.

    ``n`` is the number of user turns, so no conversation has to be in the rows.
    Narrow rows are written once, as they are needed three times.
    """
    picked = F.when(n > 1, F.col(answer).try_cast("int")).otherwise(F.lit(1))
    valid = pairs.withColumn("picked_turn", picked).filter((F.col("picked_turn") >= 1) & (F.col("picked_turn") <= n))
    once = materialised(first_per_key(valid, list(keys), [F.col(c) for c in order]))
    ids = dense_ids(once if "dwa" in keys else valid, "dwa", "category_idx")
    return skew_join(once, ids, ["dwa"]).drop(answer)


def select_kept_turns(pairs: DataFrame, keep: str, columns: list[str], **params) -> DataFrame:
    """Turn selection of the pairs whose ``keep`` column is true.

    Returns ``columns`` and what the selection adds.
    """
    chosen = select_turns(pairs.filter(F.coalesce(F.col(keep), F.lit(False))), **params)
    return chosen.select(*columns, "category_idx", "picked_turn", "convo_subset")


def dwa_summary(selected: DataFrame, *, first: dict[str, str] | None = None, order: list[str] = ()) -> DataFrame:
    """Per DWA its category id and number of instances.

    ``first`` names columns (output: input) of which the first value in ``order``
    is kept.
    """
    firsts = [F.min_by(c, F.struct(*order)).alias(name) for name, c in (first or {}).items()]
    return selected.groupBy("dwa").agg(
        F.min("category_idx").alias("category_idx"),
        F.count(F.lit(1)).alias("n_instances"),
        *firsts,
    )


def dwa_members(selected: DataFrame, columns: list[str]) -> DataFrame:
    """The lists per DWA as rows: distinct values of ``columns`` of each category."""
    return selected.select("dwa", "category_idx", *columns).distinct()


def sample_rows(df: DataFrame, n: int, *, seed: int, keys: list[str]) -> DataFrame:
    """``n`` rows in seeded hash order of the key columns."""
    return df.orderBy(stable_order(seed, *keys), *keys).limit(n)


def sample_groups(df: DataFrame, group: str, n: int, *, seed: int) -> DataFrame:
    """All rows of ``n`` sampled group values."""
    chosen = df.select(group).distinct().orderBy(stable_order(seed, group), group).limit(n)
    return skew_join(df, chosen, [group], "left_semi")


def occupation_filter(df: DataFrame, names: DataFrame | None, column: str = "category_occ") -> DataFrame:
    """Rows of the listed occupations; without a list (or an empty one) all rows."""
    if names is None or names.isEmpty():
        return df
    return skew_join(df, names.select(column).distinct(), [column], "left_semi")


def drop_server_errors(
    battles: DataFrame, *, games: str = "games", error_text: str = "Server error"
) -> DataFrame:
    """Battles where no answer in either judge prompt is the error text."""
    hit = F.lit(False)
    for g in (0, 1):
        prompt = F.get(F.get(F.col(games), F.lit(g))["prompt"], F.lit(1))["content"]
        hit = hit | C.has_server_error(prompt, error_text)
    return battles.filter(~hit)
