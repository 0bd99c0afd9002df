"""Labels, numbers and status columns out of free-text model output."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import (
    _col,
    all_groups,
    bind,
    filled_tag,
    first_code_block,
    first_group,
    last_match,
    squeeze,
    tag,
    tag_pattern,
    tags,
    unfenced,
    ws_strip,
    xml_escape,
)

# ---- fixed values: score of each label, per taxonomy -----------------------
SCORE_MAPS = {
    "original": {"E0": 0.0, "E1": 1.0, "E2": 0.5, "E3": 0.5},
    "new": {"A": 0.0, "B": 0.25, "C": 0.5, "D": 0.75, "E": 1.0},
    "synthetic": {"A": 0.05, "B": 0.205, "C": 0.455, "D": 0.73, "E": 0.93},
    "residual": {"A": 1.0, "B": -1.0, "C": 0.0},
    "residual_relabel": {"A": 1.0, "B": 0.5, "C": -0.5, "D": -1.0, "E": 0.0},
    "interview_binary": {"yes": 1.0, "no": 0.0},
    "interview_cat5": {f"{p}%": p / 100 for p in range(0, 101, 25)},
    "interview_cat10": {f"{p}%": p / 100 for p in range(0, 101, 10)},
    "interview_span": {"0-24%": 0.12, "25-49%": 0.37, "50-74%": 0.62, "75-100%": 0.87},
}
# fixed values: upper end of the span buckets
SPAN_CUTS = ((0.24, "0-24%"), (0.49, "25-49%"), (0.74, "50-74%"))
SPAN_TOP = "75-100%"
# fixed values: judge verdict -> scores in units of one game
VERDICT_SCORE = {
    "A>B": (1.0, False),
    "A>>B": (1.0, True),
    "A=B": (0.5, False),
    "A<<B": (0.0, True),
    "A<B": (0.0, False),
    "B>A": (0.0, False),
    "B>>A": (0.0, True),
    "B=A": (0.5, False),
    "B<<A": (1.0, True),
    "B<A": (1.0, False),
}
STRONG_WEIGHT = 3
# fixed values: verdict patterns, in order of preference
VERDICT_PATTERNS = (r"\[\[([AB<>=]+)\]\]", r"\[([AB<>=]+)\]")
# fixed values: accepted letters of the multiple-choice votes
KEEP_SETS = {"ABC": "ABC", "ABCD": "ABCD", "A": "A"}
MINUTE_UNITS = ("minute", "minutes", "min", "mins")
HOUR_UNITS = ("hour", "hours", "hr", "hrs")
# ----------------------------------------------------------------------------


def lookup(c, mapping: dict) -> Column:
    """Map lookup as a CASE chain, NULL for unknown keys."""
    c = _col(c)
    out = F.lit(None)
    for key, value in reversed(list(mapping.items())):
        out = F.when(c == F.lit(key), F.lit(value)).otherwise(out)
    return out


def score(c, taxonomy: str) -> Column:
    return lookup(c, SCORE_MAPS[taxonomy]).cast("double")


def mcq(c, choices: str | list[str] = "ABCDEF") -> Column:
    """Choice in the first one-line ``<answer>``, letters only, any case."""
    inner = first_group(c, r"(?d)<answer>(.*?)</answer>")
    letters = F.lower(F.regexp_replace(inner, "[^A-Za-z]", ""))
    return lookup(letters, {ch.lower().strip(): ch for ch in choices}).cast("string")


def choice_tag(c, name: str, labels: list[str], *, not_found: str | None = "") -> Column:
    """Tag content matched against the labels, ignoring case."""
    inner = F.lower(tag(c, name, ignore_case=True))
    found = lookup(inner, {x.strip().lower(): x for x in labels})
    return F.coalesce(found, F.lit(not_found)).cast("string")


def positive_int(c) -> Column:
    return F.coalesce(
        ws_strip(tag(c, "answer", ignore_case=True)).try_cast("int") > 0, F.lit(False)
    )


def index_list(c) -> Column:
    """Comma list of integers in ``<answer>``; empty gives [], anything else NULL."""
    inner = tag(c, "answer")
    numbers = F.transform(F.split(inner, ","), lambda x: ws_strip(x).try_cast("int"))
    return F.when(inner == "", F.array().cast("array<int>")).when(
        F.forall(numbers, lambda x: x.isNotNull()), numbers
    )


# fixed value: a tag with its content, up to the first closing tag of its name
TAG_PAIR = r"(?s)<([A-Za-z_][\w\-.]*)(?:\s+[^>]*)?>(.*?)</\1>"


def _tag_pairs(body) -> Column:
    """Tags from left to right as (name, value); what stands inside a tag is its value."""
    return F.transform(
        F.arrays_zip(all_groups(body, TAG_PAIR, 1).alias("name"), all_groups(body, TAG_PAIR, 2).alias("value")),
        lambda p: F.struct(p["name"].alias("name"), ws_strip(p["value"]).alias("value")),
    )


def _values(pairs, name) -> Column:
    return F.transform(F.filter(pairs, lambda p: p["name"] == name), lambda p: p["value"])


def tag_lists(c, names: list[str], *, require_fence: bool = True) -> Column:
    """Struct with one array of stripped contents per requested tag.

    NULL when a code fence is required and missing.  A tag that does not occur
    has an empty array; one that repeats has every value in order.  A tag nested
    in another one belongs to that one's content.
    """
    body = unfenced(c, required=require_fence)
    found = bind(_tag_pairs(body), lambda p: F.struct(*[_values(p, n).alias(n) for n in names]))
    return F.when(body.isNotNull(), found)


def tag_map(c, *, require_fence: bool = True) -> Column:
    """Map of every tag name to the array of its stripped contents."""
    body = unfenced(c, required=require_fence)
    found = bind(_tag_pairs(body), lambda p: F.map_from_entries(F.transform(
        F.array_distinct(F.transform(p, lambda x: x["name"])),
        lambda n: F.struct(n.alias("name"), _values(p, n).alias("values")),
    )))
    return F.when(body.isNotNull(), found)


def letter_answer(c, last: str = "E", *, name: str = "answer") -> Column:
    """Single letter from A to ``last`` in a tag, any case."""
    return F.upper(first_group(c, rf"(?i)<{name}>\s*([A-{last}])\s*</{name}>"))


def exposure_answer(c) -> Column:
    """E0 .. E3 on the last line."""
    line = F.try_element_at(F.split(F.upper(ws_strip(c)), "\n"), F.lit(-1))
    return first_group(line, r"\b(E[0-3])\b")


def double_answer(c) -> Column:
    return F.struct(
        letter_answer(c, name="answer_observed").alias("observed"),
        letter_answer(c, name="answer_perfect").alias("perfect"),
    )


def allowed_answer(c, allowed: list[str]) -> Column:
    if not allowed:
        return F.lit(None).cast("string")
    alternatives = "|".join(rf"\Q{a}\E" for a in allowed)
    return F.lower(first_group(c, rf"(?i)<answer>\s*({alternatives})\s*</answer>"))


def summary(c, name: str = "summary") -> Column:
    return ws_strip(first_group(c, tag_pattern(name, flags="d")))


def yes_no(c) -> Column:
    return lookup(F.lower(ws_strip(c)), {"yes": True, "no": False}).cast("boolean")


def yes_no_items(c, name: str = "item") -> Column:
    return F.transform(tags(c, name), yes_no)


def verdict(c, patterns=VERDICT_PATTERNS) -> Column:
    """Last non-empty match of the first pattern that matches at all."""
    upper = F.upper(_col(c))
    return F.coalesce(*[last_match(upper, p) for p in patterns])


def verdict_scores(c, weight: int = STRONG_WEIGHT) -> Column:
    """Array of scores of a verdict; strong verdicts count ``weight`` times."""
    c = _col(c)
    table = {
        v: (s, weight if strong else 1) for v, (s, strong) in VERDICT_SCORE.items()
    }
    base = lookup(c, {v: s for v, (s, _) in table.items()}).cast("double")
    times = lookup(c, {v: n for v, (_, n) in table.items()}).cast("int")
    return F.when(base.isNotNull(), F.array_repeat(base, times))


_AMOUNT = r"\d+(?:\.\d+)?"
# one or two amounts and a word behind them
_QUANTITY = rf"({_AMOUNT})(?:\s*[-–—]\s*({_AMOUNT}))?(?:\s*([a-z]+))?"


def minutes(c) -> Column:
    """Duration text to ``struct(value, error)`` in minutes.

    The quantities of a text are taken apart once: low, high and unit.  A range (its
    midpoint counts) goes before a quantity with a unit, and a text that is one bare
    amount is in minutes; a missing duration is zero.  Negative values, unknown units
    and other text set ``error``.
    """
    plain = F.translate(F.lower(ws_strip(c)), "~", "")
    # a leading "more than" or "less than" sign says nothing about the amount
    plain = F.coalesce(F.regexp_replace(plain, r"\A[<>]\s*", ""), F.lit(""))
    return bind(plain, lambda t: bind(_quantities(t), lambda q: _minutes_of(t, q)))


def _quantities(t) -> Column:
    """All quantities of a text in order, missing parts empty."""
    return F.arrays_zip(*[
        F.regexp_extract_all(t, F.lit(_QUANTITY), F.lit(g)).alias(n) for g, n in enumerate(("low", "high", "unit"), 1)
    ])


def _minutes_of(t, quantities) -> Column:
    factors = {u: f for units, f in ((MINUTE_UNITS, 1.0), (HOUR_UNITS, 60.0), (("",), 1.0)) for u in units}
    below_zero = F.concat(F.lit(" "), t).rlike(r"\s-\s*\d")
    missing = t.isin("", "not_specified", "not specified")
    chosen = F.coalesce(
        F.get(F.filter(quantities, lambda q: q["high"] != ""), F.lit(0)),
        F.get(F.filter(quantities, lambda q: q["unit"] != ""), F.lit(0)),
        F.when(t.rlike(rf"\A{_AMOUNT}\z"), F.get(quantities, F.lit(0))),
    )

    def read(q):
        low, high = (q[end].try_cast("double") for end in ("low", "high"))
        return (low + F.coalesce(high, low)) / 2 * lookup(q["unit"], factors).cast("double")

    value = F.when(missing, F.lit(0.0)).when(~below_zero, bind(chosen, read))
    why = F.when(below_zero, "negative").when(chosen.isNotNull(), "unit").otherwise("unparsed")
    return bind(value, lambda v: F.struct(v.alias("value"), F.when(v.isNull(), why).alias("error")))


_ACTIVITY_FIELDS = (
    "activity_description",
    "belongs_to_task_being_scored",
    "reported_time_savings_minutes",
    "original_time_minutes",
)


def activities(c) -> Column:
    """Activity blocks to ``struct(activities, error)``.

    Each activity has description, belongs, saved and original minutes.  One
    bad block makes the whole output an error, as the caller re-asks for it.
    """
    block = first_group(c, tag_pattern("activity_task_matches"))
    raw = all_groups(block, tag_pattern("activity"))

    def unspecified(x):
        return F.replace(F.lower(x), F.lit("_"), F.lit(" ")) == "not specified"

    def fields(x):
        return F.struct(
            *[filled_tag(x, f).alias(n) for f, n in zip(_ACTIVITY_FIELDS, ("d", "b", "s", "o"))]
        )

    def numbers(x):
        return F.struct(
            x["d"].alias("d"),
            F.lower(x["b"]).alias("b"),
            (x["s"].isNull() | x["o"].isNull()).alias("gap"),
            (unspecified(x["s"]) | unspecified(x["o"])).alias("zero"),
            minutes(x["s"]).alias("s"),
            minutes(x["o"]).alias("o"),
        )

    def parse(x):
        error = (
            F.when(x["d"].isNull() | x["b"].isNull() | x["gap"], F.lit("missing field"))
            .when(~x["b"].isin("yes", "no"), F.lit("belongs must be yes or no"))
            .when(x["zero"], F.lit(None).cast("string"))
            .otherwise(F.coalesce(x["s"]["error"], x["o"]["error"]))
        )
        return F.struct(
            x["d"].alias("description"),
            (x["b"] == "yes").alias("belongs"),
            F.when(x["zero"], F.lit(0.0)).otherwise(x["s"]["value"]).alias("saved"),
            F.when(x["zero"], F.lit(0.0)).otherwise(x["o"]["value"]).alias("original"),
            error.alias("error"),
        )

    parsed = F.transform(F.transform(F.transform(raw, fields), numbers), parse)
    return bind(
        F.struct(block.isNull().alias("no_block"), parsed.alias("parsed")), _activities_result
    )


def _activities_result(r) -> Column:
    parsed = r["parsed"]
    first_error = F.get(
        F.filter(F.transform(parsed, lambda a: a["error"]), lambda e: e.isNotNull()), F.lit(0)
    )
    error = (
        F.when(r["no_block"], F.lit("missing block"))
        .when(F.size(parsed) == 0, F.lit("no activities"))
        .otherwise(first_error)
    )
    return bind(
        error, lambda e: F.struct(F.when(e.isNull(), parsed).alias("activities"), e.alias("error"))
    )


def _total(acts, field: str) -> Column:
    return F.aggregate(
        acts, F.lit(0.0), lambda acc, a: acc + F.when(a["belongs"], a[field]).otherwise(F.lit(0.0))
    )


def span_of(saved, original) -> Column:
    """Span bucket of a savings ratio; no original time is the lowest bucket."""
    saved, original = _col(saved), _col(original)
    ratio = saved / F.nullif(original, F.lit(0.0))
    out = F.when(original == 0, F.lit(SPAN_CUTS[0][1])).when(
        (original < 0) | (ratio < 0), F.lit(None).cast("string")
    )
    for cut, name in SPAN_CUTS:
        out = out.when(ratio <= cut, F.lit(name))
    return out.when(ratio.isNotNull(), F.lit(SPAN_TOP))


def span_bucket(acts) -> Column:
    """Span bucket of an activity array: saved over original where it belongs."""
    return bind(acts, lambda a: bind(
        F.struct(_total(a, "saved").alias("s"), _total(a, "original").alias("o")),
        lambda t: span_of(t["s"], t["o"]),
    ))


def n_unmatched(acts) -> Column:
    return F.size(F.filter(_col(acts), lambda a: ~a["belongs"]))


def clean_result(c) -> Column:
    """Strip, cut blanks at line ends and collapse three or more newlines to two."""
    text = F.regexp_replace(F.coalesce(ws_strip(c), F.lit("")), r"\r\n?", "\n")
    lines = F.regexp_replace(text, r"(?mU)[^\S\n]+$", "")
    return F.regexp_replace(lines, r"\n{3,}", "\n\n")


def email(c, *, require_code: bool = False, trailing: bool = False) -> Column:
    """Email envelope to a struct of subject, body, code block and query.

    NULL when the envelope, the body, a required code block or the query is
    missing.  ``trailing`` allows more elements after the body.
    """
    tail = "(.*?)" if trailing else r"\s*"
    pattern = rf"(?is)<email>\s*<subject>(.*?)</subject>\s*<body>(.*?)</body>{tail}</email>"
    subject = ws_strip(first_group(c, pattern, 1))
    body = F.nullif(ws_strip(first_group(c, pattern, 2)), F.lit(""))
    code = first_code_block(body)
    query = F.coalesce(code, body)
    ok = body.isNotNull() & (code.isNotNull() if require_code else F.lit(True))
    return F.when(
        ok,
        F.struct(
            subject.alias("email_subject"),
            body.alias("email_body"),
            code.alias("query_codeblock"),
            query.alias("query"),
        ),
    )


_ATTACHMENT = r"(?is)<attachment>(.*?)</attachment>"


def attachments(c) -> Column:
    """Attachment blocks as an array of structs."""

    def parse(x):
        return F.struct(
            filled_tag(x, "filename", ignore_case=True).alias("filename"),
            filled_tag(x, "filesizeKb", ignore_case=True).try_cast("int").alias("filesize_kb"),
            filled_tag(x, "lengthDescription", ignore_case=True).alias("length_description"),
            filled_tag(x, "description", ignore_case=True).alias("description"),
        )

    return F.transform(all_groups(c, _ATTACHMENT), parse)


def attachments_xml(c) -> Column:
    """Raw attachment blocks joined by newlines; NULL when there is none."""
    raw = all_groups(c, _ATTACHMENT, 0)
    return F.when(F.size(raw) > 0, F.array_join(F.transform(raw, ws_strip), "\n"))


def reference_specs(xml) -> Column:
    """Reference specification built from the raw attachment blocks."""
    blocks = all_groups(xml, _ATTACHMENT)

    def line(x, source, target):
        value = filled_tag(x, source, ignore_case=True)
        return F.concat(F.lit(f"    <{target}>"), xml_escape(value), F.lit(f"</{target}>"))

    def spec(x, i):
        number = (i + 1).cast("string")
        name = F.coalesce(
            filled_tag(x, "filename", ignore_case=True), F.concat(F.lit("attachment_"), number)
        )
        return F.concat_ws(
            "\n",
            F.concat(F.lit('  <reference id="'), number, F.lit('">')),
            F.concat(F.lit("    <name>"), xml_escape(name), F.lit("</name>")),
            line(x, "filesizeKb", "filesizeKb"),
            line(x, "lengthDescription", "lengthDescription"),
            line(x, "description", "description"),
            F.lit("  </reference>"),
        )

    return F.when(
        F.size(blocks) > 0,
        F.concat(
            F.lit("<reference_specs>\n"),
            F.array_join(F.transform(blocks, spec), "\n"),
            F.lit("\n</reference_specs>"),
        ),
    )


def generated_references(c) -> Column:
    return tags(c, "referenceOutput", ignore_case=True, attributes=False)


# fixed value: an ampersand that starts no XML entity is plain text
BARE_AMPERSAND = r"&(?!(?:lt|gt|quot|apos|amp|#[0-9]+|#x[0-9a-fA-F]+);)"


def backgrounds(c) -> Column:
    """Respondent XML to an array of structs, backgrounds joined to summaries.

    One missing field, a bad number, a respondent without summary or XML that is
    not well-formed makes the whole output NULL.  Of a repeated respondent id the
    last counts, at the place of the first.
    """
    block = F.coalesce(
        ws_strip(first_group(c, r"(?is)```xml(.*?)```")),
        first_group(c, r"(?i)(<responses[\s\S]*?</responses>)"),
    )
    text = F.replace(block, F.lit("&aposs;"), F.lit("&apos;"))
    text = F.replace(text, F.lit("&aposs"), F.lit("&apos;"))

    return bind(text, lambda t: bind(_respondent_sections(t), _respondents))


def _respondent_sections(text) -> Column:
    """The two lists of respondent elements, read into structs."""

    def section(name):
        inner = first_group(text, tag_pattern(name))
        return all_groups(inner, r"(?s)(<respondent\b.*?</respondent>)")

    def unescaped(x):
        # fixed values: XML entities
        for entity, plain in (
            ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")
        ):
            x = F.replace(x, F.lit(entity), F.lit(plain))
        return x

    def field(x, name):
        return unescaped(tag(x, name))

    def ident(x):
        attr = first_group(x, r"(?s)^<respondent\b[^>]*?\bid\s*=\s*[\"']([^\"']*)[\"']")
        return ws_strip(F.coalesce(attr, tag(x, "id"))).try_cast("int")

    people = F.transform(
        section("backgrounds"),
        lambda x: F.struct(
            ident(x).alias("respondent_id"),
            field(x, "job_title").alias("job_title"),
            field(x, "years_experience").try_cast("int").alias("years_experience"),
            field(x, "company_description").alias("company_description"),
        ),
    )
    notes = F.transform(
        section("summaries"),
        lambda x: F.struct(ident(x).alias("respondent_id"), field(x, "summary").alias("summary")),
    )
    whole = F.regexp_replace(text, BARE_AMPERSAND, "&amp;")
    read = F.from_xml(
        whole, "backgrounds STRING, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}
    )
    found = text.isNotNull() & read["_corrupt"].isNull()
    return F.struct(found.alias("found"), people.alias("people"), notes.alias("notes"))


def _respondents(r) -> Column:
    """Backgrounds with their summaries, NULL when anything is missing."""

    def last(rows, ident):
        return F.try_element_at(F.filter(rows, lambda x: x["respondent_id"] == ident), F.lit(-1))

    def joined(ident):
        kept = ("respondent_id", "job_title", "years_experience", "company_description")
        p = last(r["people"], ident)
        return F.struct(*[p[f].alias(f) for f in kept], last(r["notes"], ident)["summary"].alias("summary"))

    def filled(x, names):
        out = x[names[0]].isNotNull()
        for n in names[1:]:
            out = out & x[n].isNotNull()
        return out

    names = ("respondent_id", "job_title", "years_experience", "company_description", "summary")
    notes_ok = F.forall(r["notes"], lambda n: filled(n, ("respondent_id", "summary")))

    def checked(rows):
        people_ok = F.forall(r["people"], lambda p: filled(p, names[:-1]))
        ok = r["found"] & notes_ok & people_ok & F.forall(rows, lambda x: filled(x, names))
        return F.when(F.coalesce(ok, F.lit(False)), rows)

    idents = F.array_distinct(F.transform(r["people"], lambda p: p["respondent_id"]))
    return bind(F.transform(idents, joined), checked)


def keep_votes(votes, allow: str = "ABC", *, missing: str = "E") -> Column:
    """True when every vote is in the allowed set; a missing vote has its own letter."""
    allowed = F.array(*[F.lit(ch) for ch in allow])
    return F.forall(
        _col(votes),
        lambda v: F.array_contains(allowed, ws_strip(F.coalesce(v, F.lit(missing)))),
    )


def quality_flag(answer, *, yes_is_bad: bool) -> Column:
    """Low-quality flag of one prompt; a missing answer follows the prompt's polarity."""
    answer = _col(answer)
    if yes_is_bad:
        return F.coalesce(lookup(answer, {"Yes": True, "No": False}), F.lit(True)).cast("boolean")
    return F.coalesce(lookup(answer, {"Yes": False, "No": True}), F.lit(False)).cast("boolean")


def homework_flag(answer) -> Column:
    return F.coalesce(_col(answer) == "Yes", F.lit(False))


def checklist_items(items) -> Column:
    return F.coalesce(
        F.filter(F.transform(_col(items), squeeze), lambda x: x.isNotNull() & (x != "")),
        F.array().cast("array<string>"),
    )


def checklist_score(answers) -> Column:
    """Share of true answers, a missing answer counts as not true."""
    answers = _col(answers)
    hits = F.size(F.filter(answers, lambda a: F.coalesce(a, F.lit(False))))
    return F.when(F.size(answers) > 0, hits / F.size(answers))


def numbered_items(items, template: str) -> Column:
    """One block per item; the template has {id} and {checklist_question}."""
    before, after = template.split("{checklist_question}")

    def block(x, i):
        number = (i + 1).cast("string")

        def part(text):
            pieces = text.split("{id}")
            cols = [F.lit(pieces[0])]
            for p in pieces[1:]:
                cols += [number, F.lit(p)]
            return F.concat(*cols)

        return F.concat(part(before), x, part(after))

    return F.array_join(F.transform(_col(items), block), "\n")


def contrast_sentence(c, prefix: str = "This does not include") -> Column:
    """Answer without its first line, joined; NULL unless it starts as expected."""
    lines = F.split(tag(c, "answer"), "\n")
    sentence = F.array_join(
        F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), ws_strip), " "
    )
    ok = (F.size(lines) >= 2) & F.startswith(F.lower(sentence), F.lit(prefix.strip().lower()))
    return F.when(ok, sentence)
