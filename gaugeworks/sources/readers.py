"""Readers with explicit schemas; file names become columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import conversation as C
from ..functions.text import ws_strip
from ..schemas import ANSWER, JUDGMENT, PREDICTION, QUESTION_ANY

# fixed values: collections of corpora by name
COLLECTIONS = {
    "chat_v1": ("arena_55k", "arena_100k", "lmsys_1m", "wildchat"),
    "chat_v2": ("arena_55k", "arena_100k", "lmsys_1m", "wildchat_4_8", "arena_140k_fixed"),
}


def file_stem() -> Column:
    """Name of the row's file without folder and extensions."""
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^/]*$", 1)


def named_by(column: str) -> Column:
    """Name in a partition folder ``column=name`` of the row's file, else the file's own."""
    folder = F.regexp_extract(F.input_file_name(), rf"/{column}=([^/]+)/", 1)
    return F.when(folder != "", F.url_decode(folder)).otherwise(file_stem())


# ---- conversations -----------------------------------------------------------


def paired_json_corpus(df: DataFrame, name: str, *, use_a: bool = True) -> DataFrame:
    """Corpus with JSON list columns ``prompt`` and ``response_a`` / ``response_b``."""
    side = "response_a" if use_a else "response_b"
    return _corpus(df, name, C.from_paired_json("prompt", side))


def sided_corpus(df: DataFrame, name: str, *, use_a: bool = True) -> DataFrame:
    """Corpus with ``conversation_a`` / ``conversation_b``; only one side is read."""
    return _corpus(df, name, F.col("conversation_a" if use_a else "conversation_b"))


def multipart_corpus(df: DataFrame, name: str, *, use_a: bool = True) -> DataFrame:
    """As :func:`sided_corpus` with multi-part content; a bad turn fails the job."""
    side = F.col("conversation_a" if use_a else "conversation_b")
    checked = df.filter(
        F.when(C.multipart_valid(side), F.lit(True)).otherwise(
            F.raise_error(F.lit("turn with more than one part, an image or an unknown role")).cast("boolean")
        )
    )
    return _corpus(checked, name, C.from_multipart(side))


def single_corpus(df: DataFrame, name: str, *, column: str = "conversation") -> DataFrame:
    return _corpus(df, name, C.lint(column))


def _corpus(df: DataFrame, name: str, convo: Column) -> DataFrame:
    """Normalised corpus: dataset name, local index, conversation.

    A corpus without ``local_idx`` is numbered from 0 in the order of its Parquet
    files: the place of a row in its file plus the rows of the files before, so
    only the row counts per file are gathered and no text is moved.  Tables that
    are no files are written first.
    """
    if "local_idx" in df.columns:
        return df.select(F.lit(name).alias("dset_name"), "local_idx", convo.alias("convo"))
    from ..session import materialised

    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    try:
        located = df.select(convo.alias("convo"), *place)
    except AnalysisException:
        located = materialised(df.select(convo.alias("convo"))).select("convo", *place)
    counts = located.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    firsts = counts.select(
        F.col("__file").alias("__name"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")
    )
    return located.join(F.broadcast(firsts), F.col("__file") == F.col("__name")).select(
        F.lit(name).alias("dset_name"), (F.col("__first") + F.col("__row")).alias("local_idx"), "convo"
    )


def corpora(spark: SparkSession, folder: str, collection: str | None = None) -> DataFrame:
    """Normalised table partitioned by dataset; a collection prunes the partitions."""
    df = spark.read.parquet(folder)
    return df if collection is None else df.filter(F.col("dset_name").isin(*COLLECTIONS[collection]))


def as_strings(df: DataFrame, renderer=C.render, convo: str = "convo") -> DataFrame:
    return df.withColumn("text", renderer(convo))


# ---- occupational tables -----------------------------------------------------


# fixed values: headings of the published occupational tables
TASK_DWA = {"Title": "title", "Task": "task", "DWA ID": "dwa_id", "DWA Title": "dwa_title"}
DWA_IWA = {"DWA ID": "dwa_id", "DWA Title": "dwa_title", "IWA Title": "iwa_title"}
DESIRE_OCCUPATION, DESIRE_TASK = "Occupation (O*NET-SOC Title)", "Task"


def task_dwa(spark: SparkSession, path: str) -> DataFrame:
    """Task / activity edges (CSV with headings)."""
    return _headed(spark, path, TASK_DWA)


def dwa_iwa(spark: SparkSession, path: str) -> DataFrame:
    return _headed(spark, path, DWA_IWA)


def _headed(spark: SparkSession, path: str, names: dict[str, str], sep: str = ",") -> DataFrame:
    df = spark.read.option("header", True).option("sep", sep).option("escape", '"').option(
        "multiLine", True
    ).csv(path)
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    return df.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()])


def split_task_tables(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and the distinct task space of one pull."""
    renamed = edges.select(
        F.col("title").alias("category_occ"), F.col("task").alias("category_task"), F.col("dwa_title").alias("dwa")
    )
    return renamed.distinct(), renamed.select("category_occ", "category_task").distinct()


def desires(spark: SparkSession, path: str, *, occupation: str = DESIRE_OCCUPATION, task: str = DESIRE_TASK) -> DataFrame:
    return _headed(spark, path, {occupation: "category_occ", task: "category_task"})


def reference_labels(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    return _headed(spark, path, names, sep="\t")


def occupation_list(spark: SparkSession, path: str) -> DataFrame:
    """One occupation per line, blank lines dropped."""
    return spark.read.text(path).select(ws_strip("value").alias("category_occ")).filter("category_occ <> ''")


# ---- questions, answers, predictions, judgments -------------------------------


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of either format; the last turn must be the user's.

    Single-turn lines have ``prompt``, multi-turn ones ``convo``.
    """
    raw = spark.read.schema(QUESTION_ANY).json(path)
    convo = F.coalesce("convo", C.as_conversation("prompt"))
    checked = raw.withColumn("convo", convo)
    return checked.filter(
        F.when(C.ends_with_user("convo"), F.lit(True)).otherwise(
            F.raise_error(F.lit("question that does not end with a user turn")).cast("boolean")
        )
    ).drop("prompt")


def question_format(df: DataFrame) -> str:
    """Format of a raw question table by its columns."""
    if "convo" in df.columns:
        return "multi"
    if "prompt" in df.columns:
        return "single"
    raise ValueError(f"no question format for columns {df.columns}")


def answers(spark: SparkSession, path: str) -> DataFrame:
    """Model answers, a file or partition per model; object content gives its ``answer``."""
    raw = spark.read.schema(ANSWER).json(path)

    def flat(t):
        is_object = F.startswith(F.ltrim(t["content"]), F.lit("{"))
        answer = F.when(is_object, F.get_json_object(t["content"], "$.answer"))
        return C.turn(t["role"], F.coalesce(answer, t["content"]))

    checked = raw.filter(
        F.when(C.roles_valid("messages", ("user", "assistant", "system")), F.lit(True)).otherwise(
            F.raise_error(F.lit("answer with an unknown role")).cast("boolean")
        )
    )
    return checked.withColumn("messages", F.transform("messages", flat)).withColumn("model", named_by("model"))


def model_names(answers_table: DataFrame) -> DataFrame:
    return answers_table.select("model").distinct()


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction lines of all models; token logs in the same folder are skipped."""
    raw = spark.read.schema(PREDICTION).json(path)
    return (
        raw.withColumn("model", named_by("model"))
        .filter(~F.endswith(F.input_file_name(), F.lit(".tokens.jsonl")))
        .filter(F.col("idx").isNotNull())
    )


def judgments(spark: SparkSession, base: str, judges: list[str]) -> DataFrame:
    """Judgments of one or more judges, one folder of line files per judge."""
    return spark.read.schema(JUDGMENT).json([f"{base}/{j}/*.json*" for j in judges])


def written_judgments(spark: SparkSession, base: str, judges: list[str]) -> DataFrame:
    """Judgments as the sink partitions them; other judges are not read."""
    return spark.read.schema(JUDGMENT).json(base).filter(F.col("judge").isin(*judges))


def round_columns(spark: SparkSession, base: str, name: str, columns: list[str]) -> DataFrame:
    """Some columns of one table name over all rounds."""
    return spark.read.option("basePath", base).parquet(f"{base}/*/{name}").select(*columns)


def search_result(spark: SparkSession, base: str, columns: list[str]) -> DataFrame:
    """Verified rows of a search with a query; the columns must be there."""
    df = spark.read.parquet(f"{base}/verified")
    missing = set(columns) - set(df.columns)
    if missing:
        raise ValueError(f"search result lacks {sorted(missing)}")
    out = df.filter(F.col("query").isNotNull())
    if out.isEmpty():
        raise ValueError("search result without verified rows")
    return out


def leaderboard_rows(spark: SparkSession, base: str) -> DataFrame:
    """Rows of all leaderboards, NaN scores as NULL, without prompts and answers."""
    from ..operators.comparison import nan_to_null

    return nan_to_null(spark.read.parquet(f"{base}/rows"))
