import random

import corpus_pipeline
from gaugeworks.llm import near_copies as N

from .conftest import prose


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return not (x | y) or len(x & y) >= 0.8 * len(x | y) - 1e-9


def check(rows, got):
    """No two documents left are alike, and each that went is chained to a smaller one."""
    texts = dict(rows)
    left = sorted(texts.keys() - got)
    assert not [(a, b) for i, a in enumerate(left) for b in left[:i] if alike(texts[a], texts[b])]
    reached, seen = list(left), set(left)
    while reached:
        x = reached.pop()
        for y in texts.keys() - seen:
            if alike(texts[x], texts[y]):
                seen.add(y)
                reached.append(y)
    assert seen == texts.keys()


def gone(table, rows):
    return {r.doc_id for r in N.near_copies(table(rows).select("doc_id", "text")).collect()}


def changed(text, seed, n):
    w = text.split()
    for i in random.Random(seed).sample(range(len(w)), n):
        w[i] = f"new{seed}x{i}"
    return " ".join(w)


def test_every_pair_at_the_similarity(table):
    rows = [(k, prose(k, 120)) for k in range(40)]
    rows += [(100 + 10 * k + n, changed(rows[k][1], 10 * k + n, n)) for k in range(40) for n in range(1, 5)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, rows[3][1])]
    got = gone(table, rows)
    assert {901, 902, 904, 906} <= got and not {900, 903, 905} & got
    assert {100 + 10 * k + 1 for k in range(40)} <= got  # one word of 120 changed
    check(rows, got)


def test_common_passage_and_large_group(table):
    """Documents with a common passage keep their pairs, also behind an earlier longer one."""
    passage = prose(77, 60)
    rows = [(k, f"{prose(100 + k, 60)} {passage}") for k in range(40)]
    rows += [(200 + k, changed(rows[k][1], k, 1)) for k in range(40)]
    base, whole = prose(300, 200), prose(301, 90)
    rows += [(300 + k, changed(base, k, 1)) for k in range(60)]
    rows += [(-1, f"{whole} {prose(302, 40)}"), (500, whole), (501, changed(whole, 5, 1))]
    got = gone(table, rows)
    assert {200 + k for k in range(40)} <= got and 501 in got and not {-1, 500} & got
    check(rows, got)


def test_stage_takes_lightly_edited_copies(table):
    near = prose(4000, 200).split()
    rows = [(4000 + k, " ".join(near[:30 + k] + ["dil"] + near[31 + k:])) for k in range(4)] + [(1, prose(1, 90))] * 2
    out = corpus_pipeline.near_duplicate_stage(None, table([*rows, (None, prose(1, 90))]), "")
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "4000", "None"]


def test_empty_tables(table):
    assert gone(table, []) == set()
    assert gone(table, [(2, ""), (1, None)]) == {2}
    assert N.one_row_per_id(table([])).count() == 0
