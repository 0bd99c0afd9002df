"""One id space over several corpora: ids, ranges, lookup, fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialised
from .scale import positions, skew_join

SHARD_SIZE = 250_000
PART, PART_IDS = "id_part", 1 << 16  # folder column of a laid out corpus, local indices of a folder
WANTED_IDS = 200_000  # of names and indices, some 10 MB
BUCKET_IDS = 1 << 16  # local indices counted together


def global_ids(
    corpus: DataFrame, *, dset: str = "dset_name", local: str = "local_idx", out: str = "instance_idx"
) -> DataFrame:
    """Contiguous ids: datasets in name order, rows in local order.

    Nothing is sorted as a whole: integer local indices fall into buckets of
    ``BUCKET_IDS`` values, a row's id is the number of rows in earlier datasets and
    buckets plus its place in its own bucket.  Only the dataset and the local index
    are moved; other columns are joined back by whoever needs them.  Local indices of
    another type are sorted.
    """
    keys = corpus.select(dset, local)
    if not isinstance(keys.schema[local].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        placed = positions(keys, [dset], [F.col(local)], "__pos")
        sizes = keys.groupBy(dset).agg(F.count(F.lit(1)).alias("__n"))
        # one row per dataset
        w = Window.orderBy(dset).rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select(dset, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__offset"))
        return (
            skew_join(placed, offsets, [dset], counts=sizes)
            .withColumn(out, F.col("__offset") + F.col("__pos"))
            .drop("__offset", "__pos")
        )
    keys = keys.withColumn("__bucket", F.floor(F.col(local) / F.lit(BUCKET_IDS)))
    sizes = keys.groupBy(dset, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy(dset).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.select(dset, "__bucket", "__n", F.coalesce(F.sum("__n").over(own), F.lit(0)).alias("__before"))
    totals = sizes.groupBy(dset).agg(F.sum("__n").alias("__all"))
    earlier = Window.orderBy(dset).rowsBetween(Window.unboundedPreceding, -1)  # one row per dataset
    starts = totals.select(F.col(dset).alias("__d"), F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__start"))
    offsets = inside.join(starts, inside[dset].eqNullSafe(starts["__d"])).select(
        F.col(dset).alias("__d"), F.col("__bucket").alias("__b"), (F.col("__start") + F.col("__before")).alias("__offset")
    )
    place = F.row_number().over(Window.partitionBy(dset, "__bucket").orderBy(local)) - 1
    placed = keys.withColumn("__pos", place)
    return placed.join(
        offsets, placed[dset].eqNullSafe(offsets["__d"]) & placed["__bucket"].eqNullSafe(offsets["__b"])
    ).select(dset, local, (F.col("__offset") + F.col("__pos")).alias(out))


def id_ranges(
    ids: DataFrame,
    *,
    dset: str = "dset_name",
    idx: str = "instance_idx",
    shard_size: int = SHARD_SIZE,
) -> DataFrame:
    """Ranges (start inclusive, stop exclusive) of shards of at most ``shard_size`` ids."""
    starts = ids.groupBy(dset).agg(F.min(idx).alias("__first"), F.count(F.lit(1)).alias("__n"))
    shard = F.floor((F.col(idx) - F.col("__first")) / shard_size)
    return (
        skew_join(ids.select(dset, idx), starts.drop("__n"), [dset], counts=starts.select(dset, "__n"))
        .groupBy(dset, shard.alias("shard_idx"))
        .agg(F.min(idx).alias("start"), (F.max(idx) + 1).alias("stop"))
    )


def range_gaps(ranges: DataFrame) -> DataFrame:
    """Ranges that do not continue the one before; the first must start at 0.

    The table has one row per shard, so the single ordered window is small.
    """
    w = Window.orderBy("start")
    return (
        ranges.withColumn("expected_start", F.coalesce(F.lag("stop").over(w), F.lit(0)))
        .filter(F.col("start") != F.col("expected_start"))
    )


def lookup(
    ids: DataFrame,
    ranges: DataFrame,
    *,
    idx: str = "instance_idx",
    shard_size: int = SHARD_SIZE,
) -> DataFrame:
    """Dataset and local index of each id; unknown ids keep NULL.

    Each range is listed under the id buckets it touches, which turns the range
    condition into an equi-join with one row per bucket.
    """
    first = ranges.groupBy("dset_name").agg(F.min("start").alias("first"))
    touched = F.sequence(
        F.floor(F.col("start") / shard_size), F.floor((F.col("stop") - 1) / shard_size)
    )
    listed = (
        ranges.select("dset_name", "start", "stop")
        .join(first, "dset_name")
        .withColumn("__bucket", F.explode(touched))
        .groupBy("__bucket")
        .agg(F.collect_list(F.struct("start", "stop", "first", "dset_name")).alias("__ranges"))
    )
    keyed = ids.withColumn("__bucket", F.floor(F.col(idx) / shard_size))
    found = F.filter("__ranges", lambda r: (F.col(idx) >= r["start"]) & (F.col(idx) < r["stop"]))
    return (
        skew_join(keyed, listed, ["__bucket"], "left")
        .withColumn("__r", F.get(found, F.lit(0)))
        .select(
            *ids.columns,
            F.col("__r.dset_name").alias("dset_name"),
            (F.col(idx) - F.col("__r.first")).alias("local_idx"),
        )
    )


def require_known(df: DataFrame, column: str = "dset_name") -> DataFrame:
    """Fail the job on the first id outside every range."""
    return df.withColumn(
        column,
        F.when(F.col(column).isNotNull(), F.col(column)).otherwise(
            F.raise_error(F.lit("id outside every range"))
        ),
    )


def part_of(local) -> Column:
    """Folder of a local index in a corpus laid out by ranges of them."""
    return F.floor(F.col(local) / F.lit(PART_IDS)).cast("bigint")


def write_corpus(corpus: DataFrame, path: str) -> None:
    """A corpus in folders by dataset and range of local indices, for fetches that read a few of them."""
    parts = corpus.withColumn(PART, part_of("local_idx"))
    parts.repartition("dset_name", PART).write.mode("overwrite").partitionBy("dset_name", PART).parquet(path)


def _wanted_parts(located: DataFrame, corpus: DataFrame, ignored: list[str]) -> DataFrame:
    """Conversations of the wanted ids, read from their folders only.

    The folders are named on the driver: there are no more than the corpus has.
    """
    keys = located.filter(F.col("dset_name").isNotNull())
    if ignored:
        keys = keys.filter(~F.col("dset_name").isin(*ignored))
    keys = materialised(keys.select("dset_name", "local_idx").distinct())
    folders = keys.select("dset_name", part_of("local_idx").alias("p")).distinct().collect()
    sets, parts = sorted({r[0] for r in folders}), sorted({r[1] for r in folders})
    read = corpus.filter(F.col("dset_name").isin(sets) & F.col(PART).isin(parts)).select("dset_name", "local_idx", "convo")
    if keys.count() <= WANTED_IDS:
        keys = F.broadcast(keys)
    return read.join(keys, ["dset_name", "local_idx"], "left_semi")


def fetch(
    ids: DataFrame,
    ranges: DataFrame,
    corpus: DataFrame,
    *,
    idx: str = "instance_idx",
    ignored: list[str] | None = None,
    placeholder: Column | None = None,
    shard_size: int = SHARD_SIZE,
) -> DataFrame:
    """Attach the conversation to each id, with duplicates and any order column.

    A conversation wanted by very many rows is joined with salted keys.  Rows of
    ignored datasets get the placeholder instead.  Of a corpus that ``write_corpus``
    has laid out only the folders with a wanted id are read, and up to ``WANTED_IDS``
    wanted ids meet it without moving it.
    """
    located = lookup(ids, ranges, idx=idx, shard_size=shard_size)
    if PART in corpus.columns:
        located = materialised(located)
        wanted = _wanted_parts(located, corpus, ignored or [])
    else:
        wanted = corpus.select("dset_name", "local_idx", "convo")
        if ignored:
            wanted = wanted.filter(~F.col("dset_name").isin(*ignored))
    out = skew_join(located, wanted, ["dset_name", "local_idx"], "left")
    if ignored and placeholder is not None:
        out = out.withColumn(
            "convo",
            F.when(F.col("dset_name").isin(*ignored), placeholder).otherwise(F.col("convo")),
        )
    return out
