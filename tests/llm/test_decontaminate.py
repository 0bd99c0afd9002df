import re

import pytest
from gaugeworks.llm import decontaminate as D

from .conftest import prose


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(text):
    w = words(text)
    return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    out = {}
    for i, t in docs:
        for k, q in items:
            s = shingles(q)
            if i is not None and k is not None and s:
                share = len(s & shingles(t)) / len(s)
                if share >= 0.8:
                    out[i, k] = max(out.get((i, k), 0), share)
    return out


@pytest.fixture()
def items(spark):
    rows = [(k, prose(500 + k, 12 + 9 * k)) for k in range(10)] + [
        (20, "four words only here"), (21, None), (22, ""), (None, prose(600, 30)), (23, prose(503, 39)), (24, "same same same same same same"),
    ]
    return rows, spark.createDataFrame(rows, "item_id bigint, text string")


def test_equals_brute_force(table, items, odd_rows):
    rows, frame = items
    docs = list(odd_rows)
    for k, (_, t) in enumerate(rows[:10]):
        w = t.split()
        docs.append((100 + k, f"{prose(k, 300)} {t.upper()} {prose(k + 50, 200)}"))
        docs.append((200 + k, f"{prose(k, 30)} {' '.join(w[: int(len(w) * 0.9)])} tail"))
        docs.append((300 + k, f"{prose(k, 30)} {' '.join(w[: len(w) // 2])} tail"))
        docs.append((400 + k, " ".join(w[:len(w) // 2] + ["changed"] + w[len(w) // 2 + 1:])))
    docs += [(500, "same " * 40), (100, "repeated id, other text")]
    got = {(r.doc_id, r.item_id): r.containment for r in D.contained_items(table(docs), frame).collect()}
    want = brute(docs, rows)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert len(want) > 15


def test_no_python_in_the_plan(table, items):
    plan = D.contained_items(table([(1, prose(1, 50))]), items[1])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_tables(spark, table, items):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.contained_items(table([]), items[1]).count() == 0
    assert D.contained_items(table([(1, prose(1, 50))]), none).count() == 0
    assert D.contaminated(table([]), none).count() == 0
