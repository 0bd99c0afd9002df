"""Prompt templates with ``{name}`` placeholders as column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def pieces(template: str) -> list[tuple[str, str | None]]:
    """Literal text and placeholder name, alternating; ``{{`` and ``}}`` are escapes."""
    out = []
    for text, name, spec, conversion in Formatter().parse(template):
        if name is not None and (spec or conversion or not name.isidentifier()):
            raise ValueError(f"unsupported placeholder {{{name}}} in template")
        out.append((text, name))
    return out


def fields(template: str) -> set[str]:
    return {name for _, name in pieces(template) if name is not None}


def validate(template: str, allowed) -> None:
    unknown = fields(template) - set(allowed)
    if unknown:
        raise ValueError(f"template fields {sorted(unknown)} are not among {sorted(allowed)}")


def fill(template: str, columns: dict[str, Column]) -> Column:
    """Fill a template; a missing value is written as "None"."""
    validate(template, columns)
    parts = []
    for text, name in pieces(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(columns[name].cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


def fill_from(template: str, names: list[str]) -> Column:
    """Fill a template from columns of the same name."""
    return fill(template, {n: F.col(n) for n in names})


def fill_turns(turns: list[tuple[str, str]], columns: dict[str, Column]) -> Column:
    """Fill a list of (role, template) turns into a conversation."""
    return F.array(
        *[
            F.struct(F.lit(role).alias("role"), fill(t, columns).alias("content"))
            for role, t in turns
        ]
    )


def few_shot_prefix(samples: list[dict], user: str, assistant: str) -> list[tuple[str, str]]:
    """Alternating user / assistant turns of the samples, ready to be prepended.

    Each sample must have every field the two templates name; the result has
    literal text with braces escaped again.
    """
    needed = fields(user) | fields(assistant)
    out = []
    for i, sample in enumerate(samples):
        missing = needed - set(sample)
        if missing:
            raise ValueError(f"few-shot sample {i} lacks {sorted(missing)}")
        for role, template in (("user", user), ("assistant", assistant)):
            text = template.format(**sample)
            out.append((role, text.replace("{", "{{").replace("}", "}}")))
    return out
