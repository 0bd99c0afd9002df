"""Tables of the activity hierarchy: task lists, adjacency, siblings, descriptions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..session import materialised
from .scale import dense_ids, first_per_key, null_safe, ordered_lists, skew_join

HOT_MEMBERS = 1_000  # members of a group per salt, where each meets all others
BROADCAST_NAMES = 500_000  # about 100 bytes each in a hash table
SMALL_TASK = 64  # DWAs of a task that meet as rows, beyond it as bitmaps

# fixed value: line in place of an empty list
NO_SIBLINGS = "- (no other tasks provided)"


def task_line(task, occupation) -> Column:
    return F.concat(F.lit("- "), task, F.lit(" (Occupation: "), occupation, F.lit(")"))


def dwa_task_lists(edges: DataFrame, *, dwa: str = "dwa") -> DataFrame:
    """Per DWA all its task lines."""
    lists = ordered_lists(
        edges.select(dwa, "task", "title").distinct(),
        [dwa],
        ["task", "title"],
        {"lines": task_line(F.col("task"), F.col("title"))},
    )
    return lists.select(dwa, F.array_join("lines", "\n").alias("task_statements"))


def adjacent_dwas(edges: DataFrame, *, dwa: str = "dwa") -> DataFrame:
    """(dwa, adjacent): every other DWA that shares a task, as rows."""
    _, names, pairs = _numbered_pairs(edges, dwa)
    names = _small_table(names)
    other = names.select(F.col("__own").alias("__other"), F.col(dwa).alias("adjacent"))
    return pairs.join(other, "__other").join(names, "__own").select(dwa, "adjacent")


def _numbered_pairs(edges: DataFrame, dwa: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct edges, their DWAs numbered in order as ``__own``, and the pairs (__own, __other) that share a task.

    The DWAs of a (title, task) with up to ``SMALL_TASK`` of them meet as numbers from one
    list, a pair once.  Those of a larger one are a bitmap over dense ids in blocks of
    32,768; equal bitmaps of several tasks are one, and the adjacency of a DWA is the union
    of the bitmaps it is in, so a pair becomes a row once however many large tasks share it.
    """
    keys = ["title", "task"]
    distinct = materialised(edges.select(*keys, dwa).distinct())
    names = materialised(dense_ids(distinct, dwa, "__own"))
    known = distinct.filter(F.col(dwa).isNotNull())
    # tasks that share a hash count as one: that may only send a small one to the bitmaps
    sizes = known.groupBy(F.xxhash64(*keys).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    large = materialised(sizes.filter(F.col("__n") > SMALL_TASK))
    bitmaps = not large.isEmpty()
    members = small = known.join(_small_table(names), dwa).select(*keys, "__own")
    if bitmaps:
        members = materialised(members.withColumn("__k", F.xxhash64(*keys)))
        small = skew_join(members, large.select("__k"), ["__k"], "left_anti", counts=large)
    lists = small.groupBy(*keys).agg(F.collect_list("__own").alias("__all")).filter(F.size("__all") > 1)
    pairs = lists.select("__all", F.explode("__all").alias("__own")).select("__own", F.explode("__all").alias("__other"))
    turned = F.struct(F.col("__other").alias("__own"), F.col("__own").alias("__other"))
    both = F.explode(F.array(F.struct("__own", "__other"), turned)).alias("__pair")
    pairs = pairs.filter("__own < __other").distinct().select(both).select("__pair.*")
    if bitmaps:
        wide = skew_join(members, large.select("__k"), ["__k"], "left_semi", counts=large).drop("__k")
        pairs = pairs.union(_bitmap_pairs(wide, keys, "__own")).distinct()
    return distinct, names, pairs


def _small_table(names: DataFrame) -> DataFrame:
    """Broadcast behind a count: up to ``BROADCAST_NAMES`` numbered names go to all tasks, more are joined by shuffle."""
    return F.broadcast(names) if names.count() <= BROADCAST_NAMES else names


def _bitmap_pairs(members: DataFrame, keys: list[str], dwa: str) -> DataFrame:
    """(dwa, adjacent) of tasks with many DWAs, through bitmaps of dense ids."""
    numbered = materialised(dense_ids(members, dwa, "__id"))
    ids = members.join(numbered, dwa).withColumn("__at", F.col("__id") + 1)
    block, bit = F.bitmap_bucket_number("__at"), F.bitmap_bit_position("__at")
    maps = ids.groupBy(*keys, block.alias("__block")).agg(F.bitmap_construct_agg(bit).alias("__bits"))
    # a set of DWAs is named by the blocks of its bitmap; tasks with the same set are one
    named = maps.groupBy(*keys).agg(
        F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(F.concat(F.col("__block").cast("string"), F.lit(":"), F.hex("__bits"))))), 256).alias("__set")
    )
    named = materialised(named)
    sets = skew_join(maps, named, keys, null_equal=True).select("__set", "__block", "__bits").dropDuplicates(["__set", "__block"])
    own = skew_join(ids, named, keys, null_equal=True).select("__id", "__set").distinct()
    union = skew_join(own, sets, ["__set"], hot_rows=HOT_MEMBERS).groupBy("__id", "__block").agg(F.bitmap_or_agg("__bits").alias("__bits"))

    def unpack(batches):
        for batch in batches:
            for i, block_, bits in zip(*[batch.column(c).to_pylist() for c in ("__id", "__block", "__bits")]):
                places = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
                found = places + (block_ - 1) * len(bits) * 8
                found = found[found != i]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i)), pa.array(found)], ["__id", "__other"])

    rows = union.mapInArrow(unpack, "__id bigint, __other bigint")
    left = numbered.select("__id", dwa)
    right = numbered.select(F.col("__id").alias("__other"), F.col(dwa).alias("adjacent"))
    return rows.join(left, "__id").join(right, "__other").select(dwa, "adjacent")


def does_not_include(
    dwas: DataFrame,
    pairs: DataFrame,
    *,
    prompt: str,
    criteria: str,
    dwa: str = "dwa",
) -> DataFrame:
    """Contrast texts per DWA: empty for a DWA without adjacent ones."""
    lists = ordered_lists(pairs, [dwa], ["adjacent"], {"lines": _adjacent_line("adjacent")})
    return _contrast_texts(dwas, lists, prompt, criteria, dwa)


def adjacent_contrast(edges: DataFrame, *, prompt: str, criteria: str, dwa: str = "dwa") -> DataFrame:
    """``does_not_include`` of the adjacent DWAs of the edges.

    A pair is two numbers until it is a line of its list; the numbers are in the order
    of the DWAs.
    """
    distinct, names, pairs = _numbered_pairs(edges, dwa)
    names = _small_table(names)
    lines = pairs.join(names.select(F.col("__own").alias("__other"), _adjacent_line(dwa).alias("__line")), "__other")
    lists = ordered_lists(lines, ["__own"], ["__other"], {"lines": F.col("__line")})
    return _contrast_texts(distinct, lists.join(names, "__own").select(dwa, "lines"), prompt, criteria, dwa)


def _adjacent_line(adjacent: str) -> Column:
    return F.concat(F.lit("- "), F.col(adjacent).cast("string"))


def _contrast_texts(dwas: DataFrame, lists: DataFrame, prompt: str, criteria: str, dwa: str) -> DataFrame:
    lists = lists.select(dwa, F.array_join("lines", "\n").alias("unrelated"))
    head, tail = prompt.split("{unrelated}")
    return dwas.select(dwa).distinct().join(lists, dwa, "left").select(
        dwa,
        F.when(
            F.col("unrelated").isNotNull(),
            F.concat(F.lit("\n\n" + head), F.col("unrelated"), F.lit(tail)),
        ).otherwise(F.lit("")).alias("does_not_include_prompt"),
        F.when(F.col("unrelated").isNotNull(), F.lit("\n" + criteria))
        .otherwise(F.lit(""))
        .alias("does_not_include_criteria"),
    )


def expand_to_tasks(edges: DataFrame, described: DataFrame, *, dwa: str = "dwa") -> DataFrame:
    """One description per DWA back to its (title, task) rows."""
    return skew_join(edges.select("title", "task", dwa), described, [dwa])


def join_m1(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails when the right side repeats a key."""
    checked = right.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.first(c).alias(c) for c in right.columns if c not in keys],
    )
    checked = checked.withColumn(
        "__n",
        F.when(F.col("__n") == 1, F.col("__n")).otherwise(
            F.raise_error(F.lit(f"keys {keys} repeat on the right side of an m:1 join"))
        ),
    ).filter("__n = 1").drop("__n")
    return skew_join(left, checked, keys, "left")


def iwa_children(
    edges: DataFrame, dwa_iwa: DataFrame, *, keys: list[str], detail: str
) -> DataFrame:
    """Per IWA its sorted distinct child descriptions, numbered "(i) .."."""
    linked = join_m1(edges.select(*keys, detail).distinct(), dwa_iwa.select(*keys, "iwa_title"), keys)
    lists = ordered_lists(
        linked.filter(F.col("iwa_title").isNotNull()).select("iwa_title", detail).distinct(),
        ["iwa_title"],
        [detail],
        {"children": F.col(detail)},
    )
    numbered = F.transform(
        "children", lambda x, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), x)
    )
    return lists.select("iwa_title", F.array_join(numbered, "\n").alias("children"))


def sibling_tasks(tasks: DataFrame, *, title: str = "title", task: str = "task") -> DataFrame:
    """Each task with the list of its occupation's other tasks, however many."""
    distinct = tasks.select(title, task).distinct()
    whole = ordered_lists(distinct, [title], [task], {"all_tasks": F.col(task)})
    return skew_join(distinct, whole, [title], hot_rows=HOT_MEMBERS).select(
        title, task, F.filter("all_tasks", lambda x: x != F.col(task)).alias("others")
    )


def sibling_text(others, placeholder: str = NO_SIBLINGS) -> Column:
    """Bullet lines of the other tasks, or the placeholder."""
    lines = F.array_join(F.transform(others, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(others) > 0, lines).otherwise(F.lit(placeholder))


def with_contrast(task, answer) -> Column:
    """Task text plus the accepted contrast sentence; NULL when it is rejected."""
    return F.concat(L.ws_strip(task), F.lit(" "), L.contrast_sentence(answer))


def description_map(table: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """First description per key in a defined order."""
    return first_per_key(table, [key], [F.col(c) for c in order]).select(key, value)


def attach_descriptions(
    pairs: DataFrame, maps: list[tuple[str, DataFrame]], *, strict: bool = True
) -> DataFrame:
    """Attach each (key column, two-column map); a missing entry fails the job."""
    for key, table in maps:
        value = next(c for c in table.columns if c != key)
        pairs = skew_join(pairs, table, [key], "left")
        if strict:
            pairs = pairs.withColumn(
                value,
                F.when(F.col(value).isNotNull(), F.col(value)).otherwise(
                    F.raise_error(F.lit(f"no {value} for a {key}"))
                ),
            )
    return pairs


def keep_classified(table: DataFrame, answer: str, keep: str) -> DataFrame:
    """Rows whose answer is the keep label."""
    return table.filter(F.coalesce(F.col(answer) == keep, F.lit(False)))


def dwas_of_pairs(
    edges: DataFrame, pairs: DataFrame, *, keys: list[str], dwa: str = "dwa"
) -> DataFrame:
    """All rows of the DWAs touched by the given (occupation, task) pairs."""
    touched = skew_join(edges, pairs.select(*keys).distinct(), keys, "left_semi").select(dwa).distinct()
    return skew_join(edges, touched, [dwa], "left_semi")


def occupation_tasks(
    tasks: DataFrame, *, occ: str = "category_occ", task: str = "category_task"
) -> DataFrame:
    """All sorted distinct task bullets per occupation."""
    lists = ordered_lists(
        tasks.select(occ, task).distinct(), [occ], [task], {"lines": F.concat(F.lit("- "), F.col(task))}
    )
    return lists.select(occ, F.array_join("lines", "\n").alias("occupation_tasks"))


def missing_from(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the left table that the right one lacks (empty for a subset)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, null_safe(a, b, keys), "left_anti")
