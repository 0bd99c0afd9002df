import random
import re

import numpy as np
from gaugeworks.llm import hyperminhash as H

from .conftest import prose


def shingles(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def reference(rows, least=(85, 100)):
    """All pairs of rows, components by the smallest doc_id."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, (a, _) in enumerate(rows):
        for j in range(i):
            if a is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            common = len(sets[i] & sets[j])
            if common * least[1] >= (len(sets[i]) + len(sets[j]) - common) * least[0]:
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    out = []
    for k, (i, _) in enumerate(rows):
        first = None if i is None else min(rows[m][0] for m in range(len(rows)) if group[m] == group[k] and rows[m][0] is not None)
        out.append((i, len(sets[k]), first, None if i is None else i == first))
    return sorted(out, key=str)


def run(table, rows, **options):
    return sorted(map(tuple, H.near_duplicates(table(rows), **options).collect()), key=str)


def changed(text, seed, n):
    w = text.split()
    for i in random.Random(seed).sample(range(len(w)), n):
        w[i] = f"new{seed}x{i}"
    return " ".join(w)


def test_odd_rows_copies_and_ties(table, odd_rows):
    rows = odd_rows + [(20, prose(2, 120)), (21, prose(2, 120).upper()), (22, changed(prose(2, 120), 1, 1)), (5, prose(3, 60))]
    assert run(table, rows) == reference(rows)


def test_empty_table_and_only_empty_texts(table):
    assert H.near_duplicates(table([])).count() == 0
    assert run(table, [(1, None), (2, " ")]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_groups_of_every_similarity(table):
    """Copies with one to four changed words, short texts, a common passage."""
    passage = prose(77, 70)
    rows = [(k, prose(k, 110)) for k in range(12)]
    rows += [(100 + 10 * k + n, changed(rows[k][1], 10 * k + n, n)) for k in range(12) for n in range(1, 5)]
    rows += [(400 + k, f"{passage} {prose(500 + k, 20)}") for k in range(25)]
    rows += [(600 + k, changed(prose(900, 160), k, k % 5)) for k in range(40)]
    rows += [(700 + k, " ".join(prose(950, 14 + k).split())) for k in range(8)]
    assert run(table, rows) == reference(rows)


def test_similarity_at_the_limit(table):
    """Exactly 85 of 100 counts, one less does not."""
    words = [f"w{k}" for k in range(104)]
    a = " ".join(words[:104])                       # 100 shingles
    b = " ".join(words[:89])                        # 85 of them
    c = " ".join(f"v{k}" for k in range(104))
    d = " ".join(f"v{k}" for k in range(88))        # 84 of 100
    assert run(table, [(1, a), (2, b), (3, c), (4, d)]) == [(1, 100, 1, True), (2, 85, 1, False), (3, 100, 3, True), (4, 84, 4, True)]


def test_registers_and_estimate():
    rng = np.random.default_rng(3)
    errors = []
    for n in [4, 20, 100, 500, 3000] * 20:
        extra = int(rng.integers(0, n // 3 + 1))
        pool = rng.integers(0, 2**64, n + extra, dtype=np.uint64)
        regs = H.registers([np.sort(pool[:n]), np.sort(pool[extra:])])
        errors.append(H.estimate(regs[:1], regs[1:], np.array([n]), np.array([n]))[0] - (n - extra) / (n + extra))
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < H.MARGIN
    other = [np.sort(rng.integers(0, 2**64, 400, dtype=np.uint64)) for _ in range(400)]
    regs = H.registers(other)
    share = (regs[:200] == regs[200:]).mean()
    assert 0 < share < 0.002 and abs(share - H._chance(17, 17)) < 0.0005


def test_words_hash_alone_and_in_a_slice():
    long = "y" * 1000
    alone = H.shingle_sets([f"a b {long}"], 5)[0]
    assert (H.shingle_sets(["c d e f g h", f"A\tb \n {long}", ""], 5)[1] == alone).all()


def _opened(spark, sets, hub):
    """Classes that all met one hub, with their components: those alike the hub have its own."""
    def alike(x, y):
        return 5 * len(x & y) >= 4 * len(x | y)

    component = {k: 0 if alike(v, hub) else k for k, v in sets.items()}
    opened = spark.createDataFrame([(k, 0, c) for k, c in component.items()], "class bigint, hub bigint, component bigint")
    held = [(k, sorted(v)) for k, v in [*sets.items(), (0, hub)]]
    wanted = {(a, b) for a in sets for b in sets if b < a and component[a] != component[b] and alike(sets[a], sets[b])}
    return opened, spark.createDataFrame(held, "class bigint, hashes array<bigint>"), wanted


def test_no_pair_behind_a_hub_is_lost(spark):
    """Classes mostly outside the hub, within it and linked to it, each with copies of every similarity."""
    rng = random.Random(11)
    for size in (60, 90, 160):
        hub, sets = set(rng.sample(range(10**6), size)), {}
        for k in range(25):
            base = set(rng.sample(sorted(hub), rng.randint(25, 55))) | set(rng.sample(range(10**6, 2 * 10**6), rng.randint(0, 30)))
            for copy in range(3):
                away = set(rng.sample(sorted(base), copy * rng.randint(0, 5)))
                more = set(rng.sample(sorted(hub), rng.randint(0, 4))) | set(rng.sample(range(10**6), copy * rng.randint(0, 3)))
                sets[1 + 3 * k + copy] = (base - away) | more
        opened, held, wanted = _opened(spark, sets, hub)
        got = {tuple(r) for r in H.cross_pairs(opened, held, (80, 100)).collect()}
        assert wanted and wanted <= got


def test_what_a_group_lacks_of_its_hub_is_no_token(spark):
    """Sets with one passage of the hub: what they lack of the rest is common to all of them."""
    hub = set(range(60))
    sets = {k: set(range(26)) | set(range(1000 * k, 1000 * k + 30)) for k in range(1, 41)}
    opened, held, _ = _opened(spark, sets, hub)
    tokens = H.differences(opened, held, (80, 100)).collect()
    assert len(tokens) == 40 * 30 and not {r.h for r in tokens} & hub
