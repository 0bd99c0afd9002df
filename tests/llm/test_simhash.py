import re

import numpy as np
import xxhash
from gaugeworks.llm import simhash as S

from .conftest import prose


def reference(rows, words=3):
    """Fingerprints and smallest reachable ids by comparing all pairs."""
    prints = []
    for _, text in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        shingles = [" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if group[m] == group[k] and rows[m][0] is not None]
        out.append((i, format(prints[k], "016x"), min(ids) if ids else None))
    return sorted(out, key=str)


def test_odd_rows_and_copies(table, odd_rows):
    rows = odd_rows + [(20, prose(2, 120)), (21, prose(2, 120) + " more."), (22, prose(2, 120).upper())]
    got = sorted(map(tuple, S.near_duplicates(table(rows)).collect()), key=str)
    assert got == reference(rows)


def test_empty_table(table):
    assert S.near_duplicates(table([])).count() == 0


def test_links_connect_what_pairs_connect(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base[:20].tolist():
        for _ in range(60):  # a dense group: many within three bits
            x = b
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    values = np.array(sorted(prints), np.uint64)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    links = [(np.int64(r.a).view(np.uint64), np.int64(r.b).view(np.uint64)) for r in S.fingerprint_links(frame).collect()]
    assert all(bin(int(a ^ b)).count("1") <= 3 for a, b in links)
    place = {int(v): i for i, v in enumerate(values)}

    def labels(pairs):
        parent = list(range(len(values)))

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
        return [top(i) for i in range(len(values))]

    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    assert labels([(place[int(a)], place[int(b)]) for a, b in links]) == labels(zip(*np.nonzero(np.triu(near, 1))))
