"""Building blocks that keep hot keys and long groups out of single tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised

HOT_ROWS = 1_000_000
MOST_SPREAD = 2_000  # partitions that a table of few splits is dealt out to
GROUP_LIMIT = 1_000  # spark.sql.optimizer.windowGroupLimitThreshold
_SECOND = "second"  # sets the second hash of a text apart
_PID_SHIFT = 33  # monotonically_increasing_id keeps the partition above this bit


def _cols(df: DataFrame, names: list[str]) -> list[Column]:
    return [df[n] for n in names]


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key in the given order.

    ``row_number() = 1`` is planned with a group limit before the exchange, so
    each map task sends one row per key, however large the key is.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int, rank: str) -> DataFrame:
    """First ``k`` rows of each key with their rank from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn(rank, F.row_number().over(w))
        .filter(F.col(rank) <= k)
        .withColumn(rank, F.col(rank) - 1)
    )


def positions(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """Contiguous position from 0 within each key, without one task per key.

    A global sort splits a large key over many partitions.  The sorted table is
    written with its partition and row numbers, which fixes them; the position
    is the local position plus the number of rows of that key in earlier
    partitions.
    """
    sort_cols = [F.col(k) for k in keys] + list(order)
    s = materialised(df.orderBy(*sort_cols).withColumn("__mid", F.monotonically_increasing_id()))
    s = s.withColumn("__pid", F.shiftright("__mid", _PID_SHIFT)).withColumn(
        "__at", F.col("__mid").bitwiseAND((1 << _PID_SHIFT) - 1)
    )
    runs = s.groupBy("__pid", *keys).agg(
        F.min("__at").alias("__lo"), F.count(F.lit(1)).alias("__n")
    )
    # one row per partition and key: for a hot key, as many as it has partitions
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__pid").rowsBetween(
        Window.unboundedPreceding, -1
    )
    runs = runs.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__pid").alias("__run_pid"),
        (F.coalesce(F.sum("__n").over(w), F.lit(0)) - F.col("__lo")).alias("__shift"),
    )
    cond = s["__pid"] == runs["__run_pid"]
    for k in keys:
        cond = cond & s[k].eqNullSafe(runs[f"__k_{k}"])
    return s.join(runs, cond).select(
        *[s[c] for c in df.columns], (F.col("__at") + F.col("__shift")).alias(out)
    )


def dense_ids(values: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct values of a column numbered from 0 in sort order."""
    distinct = values.select(column).filter(F.col(column).isNotNull()).distinct()
    return positions(distinct, [], [F.col(column)], out)


def with_group_stats(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Attach aggregates of each row's group.

    A window over a hot key would put the whole group into one task; the
    aggregate is combined on the map side and joined back instead.  Its row
    count names the hot keys, so nothing is read again for them.
    """
    stats = df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("__rows"))
    return skew_join(
        df, stats.drop("__rows"), keys, "left", null_equal=True, counts=stats.select(*keys, "__rows")
    )


def text_hashes(text) -> list[Column]:
    """Two independent 64-bit hashes of a text."""
    text = F.col(text) if isinstance(text, str) else text
    return [F.xxhash64(text).alias("__h"), F.xxhash64(F.lit(_SECOND), text).alias("__g")]


def distinct_texts(rows: DataFrame, texts: DataFrame, keys: list[str], key: str, text: str, out: str) -> DataFrame:
    """Number of distinct texts per ``keys`` of the rows, which name their text by ``key``.

    Exact, and no text is moved: a text is hashed where it is read and stands for its
    first hash as long as all its rows agree in the second.  Only if some do not, the
    texts of those hashes are fetched and compared.
    """
    hashed = texts.select(key, *text_hashes(text))
    pairs = skew_join(rows.select(*keys, key), hashed, [key])
    seen = materialised(
        pairs.groupBy(*keys, "__h").agg(F.min("__g").alias("__lo"), F.max("__g").alias("__hi"))
    )
    clear = seen.filter("__lo = __hi").groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")) if keys else (
        seen.filter("__lo = __hi").agg(F.count(F.lit(1)).alias("__n")))
    unclear = seen.filter("__lo <> __hi")
    if not unclear.isEmpty():
        again = pairs.join(unclear.select(*keys, "__h"), [*keys, "__h"], "left_semi")
        full = again.join(texts.select(key, F.col(text).alias("__t")), key).select(*keys, "__t").distinct()
        more = full.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        clear = clear.unionByName(more)
        return clear.groupBy(*keys).agg(F.sum("__n").alias(out))
    return clear.withColumnRenamed("__n", out)


def hot_keys(counts: DataFrame, keys: list[str], rows: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of salts they need.

    There are at most rows / hot_rows of them.
    """
    return counts.filter(F.col(rows) > hot_rows).select(
        *keys, F.ceil(F.col(rows) / hot_rows).cast("int").alias("__fan")
    )


def skew_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "inner",
    *,
    counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    null_equal: bool = False,
) -> DataFrame:
    """Join a table with very frequent keys to a table with few rows per key.

    Rows of a hot key get a salt, one per ``hot_rows`` rows, and the matching
    rows on the other side are repeated for each salt, so that no task holds a
    whole hot key.  (Adaptive execution does not split a join whose other side
    is an aggregate on the same key, which is the usual case here.)  The list of
    hot keys is broadcast; it has at most one key per ``hot_rows`` rows.

    ``counts`` gives the rows per key (keys and one more column) where they are
    known already; otherwise the key columns are counted first.  Salts come from
    the whole row, so rows of ``big`` should have an id.  ``how`` is inner, left,
    left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    rows = next(c for c in counts.columns if c not in keys)
    hot = hot_keys(counts, keys, rows, hot_rows)
    hot = F.broadcast(hot.withColumnsRenamed({k: f"__h_{k}" for k in keys}))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys])

    def marked(df):
        return df.join(hot, same, "left").drop(*[f"__h_{k}" for k in keys])

    salt = F.when(
        F.col("__fan").isNotNull(), F.pmod(F.xxhash64(*_hashable(big)), F.col("__fan")).cast("int")
    ).otherwise(0)
    left = marked(big).withColumn("__salt", salt).drop("__fan")
    right = (
        marked(small)
        .withColumn("__rsalt", F.explode(F.sequence(F.lit(0), F.coalesce("__fan", F.lit(1)) - 1)))
        .drop("__fan")
        .withColumnsRenamed({k: f"__r_{k}" for k in keys})
    )
    equal = [
        F.col(k).eqNullSafe(F.col(f"__r_{k}")) if null_equal else F.col(k) == F.col(f"__r_{k}")
        for k in keys
    ]
    # the salt comes last: rows are sorted by the first key first
    cond = reduce(lambda a, b: a & b, [*equal, F.col("__salt") == F.col("__rsalt")])
    out = left.join(right, cond, how)
    return out.drop("__salt", "__rsalt", *[f"__r_{k}" for k in keys])


def _hashable(df: DataFrame) -> list[Column]:
    """Columns that can be hashed (maps can not)."""
    return [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def slice_of(df: DataFrame, keys: list[str], parts: int, part: int) -> DataFrame:
    """The rows whose keys belong to one of several slices."""
    return df if parts == 1 else df.filter(F.pmod(F.xxhash64(*keys), F.lit(parts)) == part)


def ordered_lists(df: DataFrame, keys: list[str], order: list[str], items: dict[str, Column]) -> DataFrame:
    """One row per key with the whole list of its rows, in order.

    For texts that hold all rows of a key, so the list is as long as the key has
    rows; relations are kept as rows instead.  The order columns must tell the
    rows of a key apart.
    """
    entry = F.struct(*[F.col(o) for o in order], *[c.alias(f"__i_{n}") for n, c in items.items()])
    grouped = df.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("__l"))
    return grouped.select(*keys, *[F.col(f"__l.__i_{n}").alias(n) for n in items])


def stable_order(seed: int, *cols) -> Column:
    """Seeded MD5 order for sampling: every run, and plain SQL, picks the same rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for work that is heavy per row on a table of few partitions.

    Files of few, small rows come in few splits: they are dealt out to as many
    partitions as a shuffle has, four per core at least.  A large table already has
    more partitions and is left as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * cores:
        return df
    shuffled = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "1"))
    return df.repartition(max(4 * cores, min(shuffled, MOST_SPREAD)))
