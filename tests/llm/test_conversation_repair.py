import hashlib
import random
import re
import zlib

import pytest
from gaugeworks.llm import conversation_repair as C
from gaugeworks.llm.catalog import LLM_QUERIES, LLM_SQL

SCHEMA = "conv_id bigint, turn bigint, role string, text string, fault string, n bigint, part int"
BLANK = "\t\n\x0b\x0c\r "


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        out += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def reference(rows):
    """Cheapest edits by keeping, per state, the least (cost, audit) of all rows so far."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, f"{r[2]}:{hashlib.md5(r[3].encode()).hexdigest()}"))
    seen, counts, faults = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, _, role, text in rows:
        bare = text.rstrip(BLANK)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    after = lambda word, x: re.fullmatch(r"s?(ua)*u?", word + x) is not None

    def closed(best):
        for _ in range(3):
            for word, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    if after(word, role[0]):
                        key = short(word + role[0])
                        best[key] = min(best.get(key, (10**9, "", ())), (cost + 5, audit + "I", lines + (f"{role}:",)))
        return best

    def short(word):  # enough to say what may follow
        return word if len(word) < 4 else word[-2:] if word[-1] == "a" else word[-3:]

    best = closed({"": (0, "", ())})
    for (_, _, role, text), fault in zip(rows, faults):
        then = {}

        def put(word, value):
            then[short(word)] = min(then.get(short(word), (10**9, "", ())), value)

        for word, (cost, audit, lines) in best.items():
            put(word, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault else 0
            if role[:1] and after(word, role[:1]):
                put(word + role[:1], (cost + more, audit + "K", lines + (f"{role}:{text}",)))
            for other in ("user", "assistant"):
                if after(word, other[0]):
                    put(word + other[0], (cost + more + 1, audit + "R", lines + (f"{other}:{text}",)))
        best = closed(then)
    cost, audit, lines = min(v for w, v in best.items() if re.fullmatch(r"(s?(ua)+)?", w))
    turns = [t for _, t, _, _ in rows if t is not None]
    first = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    after = damage(rows)
    return {c: reference([r for r in after if r[0] == c]) for c in {r[0] for r in rows}}


def got(spark, rows):
    frame = spark.createDataFrame([(*r, "f", 1, 2) for r in rows], SCHEMA)
    return {r[0]: tuple(r[1:]) for r in C.repair(frame).collect()}


def conversation(rng, conv, n):
    turns = sorted(rng.sample(range(3 * n + 1), n))
    texts = ["Yes.", "Why?", "no end", "", "  \t", "Go on! ", "ends. \n", "a.b", "Ünïcode…", "x" * 30 + "!"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "agent", ""]
    out = [(conv, t, rng.choice(roles), rng.choice(texts)) for t in turns]
    return out + [(conv, None, "system", "Be nice.")] * (n % 3 == 0)


def test_small_conversations(spark):
    rng = random.Random(4)
    rows = [r for conv in range(400) for r in conversation(rng, conv, rng.randint(1, 9))]
    rows += [(900, 1, None, None), (901, None, "user", "One?"), (901, None, "assistant", "Two."), (None, 3, "user", "x."), (902, 7, "user", None)]
    rows += [(903, 1, "user", "Tie."), (903, 1, "assistant", "Tie."), (903, 1, "user", "Tie.")]
    want = expected(rows)
    assert got(spark, rows) == want
    assert {e for v in want.values() for e in v[6]} == set("DKR")  # at these costs an insertion never pays


def test_long_conversation_in_blocks(spark):
    rng = random.Random(5)
    rows = [r for conv, n in ((1, 3000), (2, C.STRIDE), (3, C.STRIDE * C.STRIDE)) for r in conversation(rng, conv, n)]
    rows = [(c, t, r, f"{t} {x}" if x.strip() else x) for c, t, r, x in rows]
    assert got(spark, rows) == expected(rows)


def test_marks_stay_near_the_square_root():
    marks = C.Marks()
    for k in range(200_000):
        marks.add("ua"[k % 2], None)
    assert len(marks.kept) <= marks.stride <= 2 * 450


def test_every_row_dropped_and_empty_table(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(spark, [(conv, 0, "user", "Hi.")]) == {conv: empty}
    assert got(spark, []) == {}


@pytest.mark.parametrize("roles, edits", [
    (["user", "assistant"], "KK"), (["system", "user", "assistant"], "KKK"), (["user", "user", "assistant", "assistant"], "KRRK"),
    (["assistant"], "D"), (["system"], "D"), (["user", "system", "assistant"], "KDK"), (["user", "user"], "KR"),
])
def test_edits(roles, edits):
    assert reference([(1, k, r, f"t{k}.") for k, r in enumerate(roles)])[6] == edits


def test_query_and_sql(spark, tmp_path):
    rng = random.Random(6)
    rows = [r for conv in range(60) for r in conversation(rng, conv, rng.randint(1, 7))]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = LLM_QUERIES["op11_conversation_repair"](spark, str(tmp_path))
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == expected(rows)
    if "op11_conversation_repair" in LLM_SQL:
        import duckdb

        duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        twin = duckdb.sql(LLM_SQL["op11_conversation_repair"])
        at = [twin.columns.index(c) for c in found.columns]
        assert {r[at[0]]: tuple(r[i] for i in at[1:]) for r in twin.fetchall()} == expected(rows)
