"""Request and response tables around model calls.

A job renders prompts into requests, writes the ones without an answer as a
table, and joins the response table by request hash.  The model itself stays
outside; a responder function can answer pending rows inside Spark tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RESPONSE
from .scale import first_per_key, skew_join


def request_hash(prompt, **params) -> Column:
    """SHA-256 of the canonical JSON of prompt and call parameters.

    The prompt is a text or a conversation; parameters (model, schema, cache
    flag) are part of the key.
    """
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt
    fields = [F.lit(str(params[k])).alias(k) for k in sorted(params)]
    return F.sha2(F.to_json(F.struct(*fields, prompt.alias("prompt"))), 256)


def args_hash(params: dict) -> Column:
    """SHA-1 of the call parameters as sorted JSON."""
    pairs = [F.lit(str(params[k])).alias(k) for k in sorted(params)]
    return F.sha1(F.to_json(F.struct(*pairs)))


def pending(requests: DataFrame, responses: DataFrame, *, prompt: str = "prompt") -> DataFrame:
    """Distinct requests without any response."""
    distinct = requests.groupBy("request_hash").agg(F.first(prompt).alias(prompt))
    return distinct.join(responses.select("request_hash").distinct(), "request_hash", "left_anti")


def answer_pending(
    requests: DataFrame, responder: Callable[[pd.Series], pd.DataFrame], *, prompt: str = "prompt"
) -> DataFrame:
    """Answer pending requests with a function from prompts to response rows.

    The function gets the prompts of one Arrow batch and returns a frame with
    any of the response columns; the others are left empty.
    """
    names = [part.split()[0] for part in RESPONSE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = responder(batch[prompt]).reset_index(drop=True)
            out.insert(0, "request_hash", batch["request_hash"].to_numpy())
            if "attempt" not in out:
                out["attempt"] = 0
            out = out.reindex(columns=names).astype(object)
            yield out.where(out.notna(), None)

    return requests.select("request_hash", prompt).mapInPandas(run, RESPONSE)


def first_valid(responses: DataFrame, valid: Column) -> DataFrame:
    """Lowest valid attempt of each request."""
    return first_per_key(responses.filter(valid), ["request_hash"], [F.col("attempt")])


def join_responses(df: DataFrame, responses: DataFrame, columns: list[str] = ("output",)) -> DataFrame:
    """Attach responses by hash; a prompt shared by very many rows is salted."""
    return skew_join(df, responses.select("request_hash", *columns), ["request_hash"], "left")


def apply_prompt(
    df: DataFrame,
    prompt: Column,
    responses: DataFrame,
    target: str,
    parser: Callable[[Column], Column] | None = None,
    *,
    valid: Callable[[Column], Column] | None = None,
    params: dict | None = None,
) -> DataFrame:
    """Render, join the answers, parse; rows without an answer get NULL."""
    keyed = df.withColumn("request_hash", request_hash(prompt, **(params or {})))
    ok = F.col("output").isNotNull()
    if valid is not None:
        ok = ok & F.coalesce(valid(F.col("output")), F.lit(False))
    best = first_valid(responses, ok).select("request_hash", F.col("output").alias("__output"))
    out = join_responses(keyed, best, ["__output"])
    value = F.col("__output") if parser is None else parser(F.col("__output"))
    return out.withColumn(target, value).drop("__output", "request_hash")


def null_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(column).isNull()).alias("n_null")
    )


def invalid_results(responses: DataFrame) -> DataFrame:
    """Rows that are neither a success nor a failure, or both."""
    return responses.filter(F.col("output").isNull() == F.col("error").isNull())


def order_gaps(df: DataFrame, idx: str = "idx") -> DataFrame:
    """Row and gap count of an index that should run 0 .. n - 1."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        (F.max(idx) + 1 - F.count_distinct(idx)).alias("n_missing"),
        (F.count(F.lit(1)) - F.count_distinct(idx)).alias("n_repeated"),
    )


def token_usage(
    responses: DataFrame,
    limits: DataFrame | None = None,
    *,
    milestone: int = 1_000_000,
    default_limit: int = 1_000_000_000,
) -> DataFrame:
    """Tokens per model, milestones passed and whether the model's limit is exceeded."""
    used = responses.groupBy("model").agg(
        F.sum("total_tokens").alias("total_tokens"), F.count(F.lit(1)).alias("n_requests")
    ).withColumn("milestones", F.floor(F.col("total_tokens") / milestone))
    if limits is None:
        return used
    return used.join(limits.select("model", "token_limit"), "model", "left").withColumn(
        "exceeded",
        F.col("total_tokens") > F.least(F.col("token_limit"), F.lit(default_limit)),
    )


def token_log(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        "idx", "total_tokens", "prompt_tokens", "completion_tokens", "reasoning_tokens"
    )


def structured(output, schema: str) -> Column:
    """Response text parsed to a schema; NULL when it is no valid JSON object."""
    output = F.col(output) if isinstance(output, str) else output
    parsed = F.from_json(
        output,
        f"{schema}, _corrupt STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    return F.when(parsed["_corrupt"].isNull() & output.isNotNull(), parsed)


#: Types of a structured answer and the variant types that are one.
VARIANT_KINDS = {
    "bigint": ("BIGINT",), "double": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "string": ("STRING",), "boolean": ("BOOLEAN",),
}


def structured_fields(variant: Column, fields: dict[str, str]) -> tuple[dict[str, Column], Column]:
    """Typed values of the paths of a parsed response, and its list of errors.

    One parse (``try_parse_json``) serves any number of schemas.  An error names the
    path and what is wrong with it: ``$: no JSON``, ``$.a.b: missing`` or ``$.a.b: string``
    for a value of another type; JSON null counts as missing.
    """
    values, errors = {}, []
    for path, kind in fields.items():
        part = F.try_variant_get(variant, path, "variant")
        found = F.when(~F.is_variant_null(part), F.regexp_extract(F.schema_of_variant(part), "^[A-Z]+", 0))
        fits = F.coalesce(found.isin(*VARIANT_KINDS[kind]), F.lit(False))
        values[path] = F.when(fits, F.try_variant_get(variant, path, kind))
        errors.append(F.when(~fits, F.concat(F.lit(f"{path}: "), F.coalesce(F.lower(found), F.lit("missing")))))
    broken = F.array_compact(F.array(*errors))
    return values, F.when(variant.isNull(), F.array(F.lit("$: no JSON"))).otherwise(broken)


def errors_by_path(df: DataFrame, output: str, fields: dict[str, str]) -> DataFrame:
    """(error, n): how many responses fail at each path of a schema."""
    parsed = df.select(F.try_parse_json(F.col(output)).alias("__v"))
    _, errors = structured_fields(F.col("__v"), fields)
    return parsed.select(F.explode(errors).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def model_columns(long: DataFrame, keys: list[str], models: list[str], value: str) -> DataFrame:
    """Long results to one column per model, for export."""
    return long.groupBy(*keys).pivot("model", models).agg(F.first(value))
