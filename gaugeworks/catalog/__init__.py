"""All registered queries."""

from . import (  # noqa: F401
    composition_queries,
    convo_queries,
    exposure_queries,
    hierarchy_queries,
    judging_queries,
    label_queries,
    plan_queries,
    retrieval_queries,
    round_queries,
    source_queries,
)
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
