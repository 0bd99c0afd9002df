from collections import defaultdict

from gaugeworks.llm import packing as P
from hypothesis import given, settings
from hypothesis import strategies as st

PIECE = st.tuples(st.integers(1, 20), st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, 1, 2, 3, 4, 5]))


def slow_best_fit(pieces, capacity, slots):
    bins = []
    out = []
    for length, source, cluster in pieces:
        fits = [
            (capacity - sum(x[0] for x in b), k) for k, b in enumerate(bins)
            if capacity - sum(x[0] for x in b) >= length
            and (cluster is None or cluster not in [x[2] for x in b])
            and (source is None or [x[1] for x in b].count(source) < slots)
        ]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append([])
        bins[k].append((length, source, cluster))
        out.append(k)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECE, max_size=40), st.integers(1, 3))
def test_equals_a_plain_best_fit(pieces, slots):
    lengths, sources, clusters = (list(c) for c in zip(*pieces)) if pieces else ([], [], [])
    assert P.best_fit(lengths, sources, clusters, 20, slots) == slow_best_fit(pieces, 20, slots)


def check(rows, items, capacity, slots):
    """All tokens once, no bin over capacity, no conflicts."""
    tokens, fill = defaultdict(int), defaultdict(list)
    for r in rows:
        tokens[r.doc_id, r.copy, r.cluster, r.source] += r.length
        if r.bin_id is not None:
            fill[r.bin_id].append(r)
        else:
            assert r.length == 0
    assert sorted(tokens.values()) == sorted(max(0, n or 0) for _, n, *_ in items)
    for pieces in fill.values():
        assert sum(p.length for p in pieces) <= capacity
        at = 0
        for p in sorted(pieces, key=lambda p: p.place):
            assert p.place == at
            at += p.length
        tails = [p for p in pieces if p.length < capacity]
        clusters = [p.cluster for p in tails if p.cluster is not None]
        assert len(clusters) == len(set(clusters))
        sources = [p.source for p in tails if p.source is not None]
        assert all(sources.count(s) <= slots for s in sources)


def test_shards_hot_sources_and_odd_rows(spark):
    items = [(k, 1 + k * 37 % 90, "hot" if k % 3 else f"s{k % 7}", k % 50) for k in range(600)]
    items += [(None, 5, None, None), (None, None, "s", 1), (700, 0, "s", 1), (701, 1000, "s", 1)]
    items += [(800, 30, "s", 9)] * 40  # repeated rows of one cluster
    frame = spark.createDataFrame(items, "doc_id bigint, length bigint, source string, cluster bigint")
    for pieces in (50, 10_000):
        out = P.pack(frame, capacity=100, slots=2, shard_pieces=pieces)
        check(out.collect(), items, 100, 2)
    long = [r for r in out.collect() if r.doc_id == 701]
    assert sorted(r.start for r in long) == list(range(0, 1000, 100)) and len({r.bin_id for r in long}) == 10


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id bigint, length bigint, source string, cluster bigint")
    assert P.pack(frame).count() == 0
