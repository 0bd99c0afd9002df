"""Stateful resume: first valid attempts and token milestones while results arrive.

State is kept per key and moves on with the query's checkpoint, so a stopped query goes
on where it ended; a timer forgets a request some time after its last attempt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_ANSWER = "request_hash STRING, attempt INT, model STRING, output STRING, total_tokens BIGINT"
# a bit per attempt that has come, the best valid one so far, whether it is out
_REQUEST = "seen BIGINT, attempt INT, model STRING, output STRING, total_tokens BIGINT, done BOOLEAN, newest BIGINT"
_MILESTONE = "model STRING, milestone BIGINT, total_tokens BIGINT, n_requests BIGINT"


def _answer(key, attempt, model, output, tokens) -> pd.DataFrame:
    return pd.DataFrame({
        "request_hash": [key[0]], "attempt": pd.array([attempt], "Int32"), "model": [model], "output": [output],
        "total_tokens": pd.array([tokens], "Int64"),
    })


def first_valid_stream(stream: DataFrame, valid: Column, *, arrived: str, late: str = "7 days") -> DataFrame:
    """First valid attempt per request of a stream of responses, as ``exchange.first_valid`` gives for a table.

    A valid attempt is given out once all lower ones have come and were not valid,
    whatever order they come in.  Once the watermark (``late`` behind the newest time in
    the column ``arrived``) has passed its newest attempt, a request gives what it has
    and is forgotten; attempts from behind the watermark are dropped.  Repeated files
    change nothing.  Attempts are numbered from 0 to 62.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, attempt, model, output, tokens, done, _ = state.get
            state.remove()
            if attempt is not None and not done:
                yield _answer(key, attempt, model, output, tokens)
            return
        seen, attempt, model, output, tokens, done, newest = state.get if state.exists else (0, None, None, None, None, False, 0)
        for frame in frames:
            for r in frame.itertuples(index=False):
                seen |= 1 << int(r.attempt)
                if r.valid and (attempt is None or r.attempt < attempt):
                    attempt, model, output = int(r.attempt), r.model, r.output
                    tokens = None if pd.isna(r.total_tokens) else int(r.total_tokens)
            newest = max(newest, int(frame["arrived"].max().timestamp() * 1000))
        lower = (1 << attempt) - 1 if attempt is not None else 0
        ready = not done and attempt is not None and seen & lower == lower
        state.update((seen, attempt, model, output, tokens, done or ready, newest))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + 1)
        if ready:
            yield _answer(key, attempt, model, output, tokens)

    rows = stream.withColumn("valid", valid).withColumn("arrived", F.col(arrived)).withWatermark("arrived", late)
    rows = rows.select("request_hash", "attempt", "model", "output", "total_tokens", "valid", "arrived")
    return rows.groupBy("request_hash").applyInPandasWithState(
        step, _ANSWER, _REQUEST, "append", GroupStateTimeout.EventTimeTimeout
    )


def milestone_stream(stream: DataFrame, *, size: int = 1_000_000) -> DataFrame:
    """(model, milestone, total_tokens, n_requests) each time a model passes another ``size`` tokens."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, requests = state.get if state.exists else (0, 0)
        before = total // size
        for frame in frames:
            total += int(frame["total_tokens"].fillna(0).sum())
            requests += len(frame)
        state.update((total, requests))
        if total // size > before:
            yield pd.DataFrame({
                "model": [key[0]], "milestone": [total // size], "total_tokens": [total], "n_requests": [requests],
            })

    return stream.select("model", "total_tokens").groupBy("model").applyInPandasWithState(
        step, _MILESTONE, "total BIGINT, requests BIGINT", "append", GroupStateTimeout.NoTimeout
    )
