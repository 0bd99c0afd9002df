"""Column functions on conversations (arrays of role / content structs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, bind, first_group, ws_strip

_ROLE_LABEL = {"user": "Human: ", "assistant": "Assistant: "}


def turn(role, content) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), _col(content).alias("content"))


def without_system(convo) -> Column:
    return F.filter(_col(convo), lambda t: t["role"] != "system")


def of_role(convo, role: str) -> Column:
    return F.filter(_col(convo), lambda t: t["role"] == role)


def roles_valid(convo, allowed=("user", "assistant")) -> Column:
    """True when every turn has an allowed role and a text."""
    return F.forall(
        _col(convo),
        lambda t: F.coalesce(t["role"].isin(*allowed), F.lit(False)) & t["content"].isNotNull(),
    )


def _label(t, user: str, assistant: str) -> Column:
    return F.concat(
        F.when(t["role"] == "user", F.lit(user)).otherwise(F.lit(assistant)), t["content"]
    )


def render(convo, *, on_system: str = "drop") -> Column:
    """"Human: .." / "Assistant: .." blocks with an empty line between.

    Only user and assistant turns can be rendered.  ``on_system='drop'`` leaves
    system turns out; ``'error'`` fails the job on any other role.
    """
    convo = _col(convo)
    if on_system == "drop":
        convo = without_system(convo)
    elif on_system != "error":
        raise ValueError(f"on_system must be 'drop' or 'error', not {on_system!r}")
    text = F.array_join(
        F.transform(convo, lambda t: _label(t, _ROLE_LABEL["user"], _ROLE_LABEL["assistant"])),
        "\n\n",
    )
    if on_system == "error":
        text = F.when(roles_valid(convo), text).otherwise(
            F.raise_error(F.lit("turn with a role other than user or assistant"))
        )
    return text


def render_human_only(convo) -> Column:
    return F.array_join(
        F.transform(
            of_role(convo, "user"), lambda t: F.concat(F.lit(_ROLE_LABEL["user"]), t["content"])
        ),
        "\n\n",
    )


def render_history(convo) -> Column:
    """Judge history: no system turns, "User: " label."""
    return F.array_join(
        F.transform(without_system(convo), lambda t: _label(t, "User: ", "Assistant: ")), "\n\n"
    )


def user_text(convo) -> Column:
    return F.array_join(F.transform(of_role(convo, "user"), lambda t: t["content"]), "\n")


def n_user_turns(convo) -> Column:
    return F.size(of_role(convo, "user"))


def _user_positions(convo) -> Column:
    """1-based positions of the user turns."""
    convo = _col(convo)
    return F.filter(
        F.transform(convo, lambda t, i: F.when(t["role"] == "user", i + 1)),
        lambda p: p.isNotNull(),
    )


def numbered_turns(convo) -> Column:
    """Turns in triple quotes; user turns carry their running number."""
    quote = F.lit('"""')

    def rendered(x):
        def block(t, i):
            number = F.array_position(x["at"], i + 1)
            head = F.when(
                t["role"] == "user",
                F.concat(F.lit("Human turn "), number.cast("string"), F.lit(": ")),
            ).otherwise(F.lit("Assistant: "))
            return F.concat(head, quote, t["content"], quote)

        return F.array_join(F.transform(x["convo"], block), "\n\n")

    convo = _col(convo)
    return bind(F.struct(convo.alias("convo"), _user_positions(convo).alias("at")), rendered)


def prefix_to_user_turn(convo, k) -> Column:
    """Turns up to and including the k-th user turn; NULL when there is none."""
    convo = _col(convo)
    k = F.lit(k) if isinstance(k, int) else _col(k)
    cut = F.get(_user_positions(convo), k - 1)
    return F.when(cut.isNotNull(), F.slice(convo, 1, cut))


def lint(convo) -> Column:
    """Keep role and content of each turn; NULL when one of them is missing."""
    convo = _col(convo)
    kept = F.transform(convo, lambda t: turn(t["role"], t["content"]))
    ok = F.forall(convo, lambda t: t["role"].isNotNull() & t["content"].isNotNull())
    return F.when(ok, kept)


def ends_with_user(convo) -> Column:
    return F.coalesce(
        F.try_element_at(_col(convo), F.lit(-1))["role"] == "user", F.lit(False)
    )


def split_turns(text, prefix: str = "Human:") -> Column:
    """Split a rendered text before each line that starts with the prefix."""
    parts = F.split(_col(text), rf"(?m)(?=^\Q{prefix}\E)")
    return F.filter(F.transform(parts, ws_strip), lambda x: x != "")


def number_turns(turns) -> Column:
    return F.array_join(
        F.transform(_col(turns), lambda x, i: F.concat(F.lit("("), i.cast("string"), F.lit(") "), x)),
        "\n\n",
    )


def drop_turns(turns, excluded) -> Column:
    """Join the turns whose 0-based index is not excluded."""
    excluded = F.coalesce(_col(excluded), F.array().cast("array<int>"))
    return bind(
        F.struct(_col(turns).alias("t"), excluded.alias("x")),
        lambda s: F.array_join(
            F.filter(s["t"], lambda t, i: ~F.array_contains(s["x"], i)), "\n\n"
        ),
    )


def first_of_role(convo, role: str) -> Column:
    return F.get(of_role(convo, role), F.lit(0))["content"]


def last_content(convo) -> Column:
    return F.try_element_at(_col(convo), F.lit(-1))["content"]


def previous_turns(convo) -> Column:
    return F.slice(_col(convo), 1, F.greatest(F.size(_col(convo)) - 1, F.lit(0)))


def previous_turns_xml(convo) -> Column:
    return F.array_join(
        F.transform(
            previous_turns(convo),
            lambda t: F.concat(
                F.lit("<turn role='"), t["role"], F.lit("'>"), t["content"], F.lit("</turn>")
            ),
        ),
        "\n",
    )


def as_conversation(query) -> Column:
    """One user turn around a query text."""
    return F.when(_col(query).isNotNull(), F.array(turn("user", query)))


def append_answer(convo, response) -> Column:
    return F.concat(_col(convo), F.array(turn("assistant", response)))


def replace_turn(convo, index, content) -> Column:
    """Swap the content of one turn (0-based; negative counts from the end)."""
    convo = _col(convo)
    index = F.lit(index) if isinstance(index, int) else _col(index)
    at = F.when(index < 0, F.size(convo) + index).otherwise(index)
    content = _col(content)
    return F.transform(
        convo,
        lambda t, i: F.when(i == at, turn(t["role"], content)).otherwise(
            turn(t["role"], t["content"])
        ),
    )


def fingerprint(convo) -> Column:
    """SHA-256 of the compact JSON with sorted keys."""
    return F.sha2(
        F.to_json(
            F.transform(
                _col(convo), lambda t: F.struct(t["content"].alias("content"), t["role"].alias("role"))
            )
        ),
        256,
    )


def example_block(convo, output, *, header: str = "### Example") -> Column:
    """Last turn and model output in a code fence; NULL when there is no output."""
    last = F.try_element_at(_col(convo), F.lit(-1))
    body = F.concat(
        F.when(last["role"] == "user", F.lit("Human: ")).otherwise(F.lit("Assistant: ")),
        last["content"],
        F.lit("\n\nAssistant: "),
        _col(output),
    )
    body = F.replace(body, F.lit("\nAssistant: "), F.lit("\nLLM: "))
    return F.concat(F.lit(f"{header}\n```\n"), body, F.lit("\n```"))


def example_block_tagged(convo, output, *, header: str = "### Example") -> Column:
    """Last user turn and model output in human / LLM tags; NULL without either."""
    human = F.try_element_at(of_role(convo, "user"), F.lit(-1))["content"]
    return F.concat(
        F.lit(f"{header}\n```\n<human>\n"),
        human,
        F.lit("\n</human>\n\n<LLM>\n"),
        _col(output),
        F.lit("\n</LLM>\n```"),
    )


def examples_text(examples, *, style: str = "plain", header: str = "### Example") -> Column:
    """Render an array of (input conversation, output) structs."""
    block = {"plain": example_block, "tagged": example_block_tagged}[style]
    blocks = F.transform(_col(examples), lambda e: block(e["input"], e["output"], header=header))
    return F.array_join(F.filter(blocks, lambda b: b.isNotNull()), "\n\n")


# fixed values: delimiters around an answer in a judge prompt
ANSWER_START = "<|The Start of Assistant {side}'s Answer|>\n"
ANSWER_END = "\n<|The End of Assistant {side}'s Answer|>"


def judge_prompt_answer_b(text) -> Column:
    """Answer of side B inside a judge prompt, as far as the last end mark."""
    start = ANSWER_START.format(side="B").rstrip("\n")
    end = ANSWER_END.format(side="B").lstrip("\n")
    return first_group(text, rf"(?s)\Q{start}\E\n(.*)\n\Q{end}\E")


def has_server_error(prompt, error_text: str = "Server error") -> Column:
    """True when either side's answer in a judge prompt is the error text."""
    prompt = _col(prompt)
    hit = F.lit(False)
    for side in ("A", "B"):
        block = ANSWER_START.format(side=side) + error_text + ANSWER_END.format(side=side)
        hit = hit | F.coalesce(F.contains(prompt, F.lit(block)), F.lit(False))
    return hit


def from_paired_json(prompts, responses) -> Column:
    """Conversation from two JSON lists; the shorter list decides, null is ''."""

    def parsed(c):
        return F.transform(
            F.from_json(_col(c), "array<string>"), lambda x: F.coalesce(x, F.lit(""))
        )

    p, r = parsed(prompts), parsed(responses)
    n = F.least(F.size(p), F.size(r))
    pairs = F.zip_with(
        F.slice(p, 1, n),
        F.slice(r, 1, n),
        lambda a, b: F.array(turn("user", a), turn("assistant", b)),
    )
    return F.flatten(pairs)


def from_multipart(convo) -> Column:
    """Turns whose content is a list of parts: the text of the only part, or ''."""
    return F.transform(
        _col(convo),
        lambda t: turn(
            t["role"], F.coalesce(F.get(t["content"], F.lit(0))["text"], F.lit(""))
        ),
    )


def multipart_valid(convo) -> Column:
    """At most one part, of type text and without an image; role user or assistant."""

    def ok(t):
        part = F.get(t["content"], F.lit(0))
        return t["role"].isin("user", "assistant") & (
            (F.size(t["content"]) == 0)
            | ((F.size(t["content"]) == 1) & (part["type"] == "text") & part["image"].isNull())
        )

    return F.forall(_col(convo), lambda t: F.coalesce(ok(t), F.lit(False)))
