from gaugeworks.llm import line_dedup as D
from hypothesis import given
from hypothesis import strategies as st

from .conftest import prose


@given(st.text(alphabet="ab .\n!", max_size=200))
def test_lines_are_the_whole_text(text):
    lines = D.cut_lines(text)
    assert "".join(text[a:b] for a, b, _ in lines) == text
    assert sum(n for *_, n in lines) == len(text.split())


def test_alignment_keeps_the_longest_order():
    assert D.aligned([(0, 5), (1, 1), (2, 2), (3, 0), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    assert D.aligned([]) == []


def test_repeated_passages_leave_the_later_document(table):
    passage = prose(50, 70)
    rows = [(k, f"{prose(k, 40)}. {passage}. {prose(k + 100, 40)}.") for k in range(1, 9)]
    rows += [(20, prose(20, 90)), (21, f"Own words here now. {' '.join(passage.split()[:9])}")]
    got = {r.doc_id: r for r in D.dedup_lines(table(rows)).collect()}
    text = dict(rows)
    assert got[1].text == text[1] and not got[1].spans
    for k in range(2, 9):
        assert passage not in got[k].text
        assert prose(k, 40)[:60] in got[k].text and prose(k + 100, 40)[-60:] in got[k].text
        left = text[k]
        for s in reversed(got[k].spans):
            left = left[: s["start"]] + left[s["stop"]:]
        assert left == got[k].text and got[k].removed == len(text[k]) - len(left)
    for k in (20, 21):  # nothing shared, or less than a block
        assert got[k].text == text[k]


def test_copies_and_odd_rows(table, odd_rows):
    rows = odd_rows + [(30, prose(2, 120)), (31, prose(2, 120)), (31, prose(2, 120))]
    out = D.dedup_lines(table(rows)).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[30] == [""] and got[31] == ["", ""] and got[12] == [prose(2, 120)]
    assert got[1] == [None] and got[2] == [""] and prose(1, 80) in got[None] and got[6] == [prose(1, 80)]
    assert len(got[8][0]) == len(prose(99, 30_000))


def test_empty_table(table):
    assert D.dedup_lines(table([])).count() == 0


def test_own_short_lines_stay(table):
    """Short lines between shared ones go only where they are the same."""
    def form(*answers):
        return "".join(f"{prose(700 + k, 12)}\nAnswer: {a}\n" for k, a in enumerate(answers)) + prose(710, 12)

    rows = [(1, form("A", "B", "C", "D")), (2, form("A", "X", "C", "Y")), (3, form("A", "B", "C", "D"))]
    got = {r.doc_id: r.text for r in D.dedup_lines(table(rows)).collect()}
    assert got[1] == rows[0][1] and got[3] == ""
    assert "Answer: X" in got[2] and "Answer: Y" in got[2] and "Answer: A" not in got[2]


def test_passages_of_short_lines(table):
    verse = "".join(f"{w}\n" for w in (" ".join(prose(800, 90).replace(".", "").split()[i:i + 2]) for i in range(0, 90, 2)))
    rows = [(k, f"{prose(810 + k, 40)}\nx{k}\ny{k}\n{verse}{prose(820 + k, 40)}") for k in range(1, 5)]
    got = {r.doc_id: r for r in D.dedup_lines(table(rows)).collect()}
    assert got[1].text == rows[0][1]
    for k in range(2, 5):
        assert got[k].removed > 0.7 * len(verse)
        assert prose(810 + k, 40) in got[k].text and prose(820 + k, 40) in got[k].text and f"x{k}\ny{k}" in got[k].text


def test_swapped_and_repeated_passages(table):
    one, two = (prose(k, 80).rsplit(".", 2)[0] for k in (830, 831))  # whole sentences
    rows = [(1, f"{two}. {one}."), (2, f"{one}. {two}."), (3, f"{one}. {two}."), (4, f"{prose(832, 40)}. {one}. {prose(833, 40)}. {one}.")]
    got = {r.doc_id: r.text for r in D.dedup_lines(table(rows)).collect()}
    assert got[1] == rows[0][1] and got[2].strip(" .") == got[3].strip(" .") == ""
    for sentence in one.split(". "):
        assert sentence not in got[4]
    assert prose(832, 40)[:60] in got[4] and prose(833, 40)[:60] in got[4]
