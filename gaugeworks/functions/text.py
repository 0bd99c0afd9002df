"""Text helpers shared by every parser.

Model output is matched with Java regular expressions.  Three traps are
handled here once: ``trim`` strips blanks only, ``regexp_extract`` answers an
empty string when nothing matched, and a bare dot stops at more characters in
Java than the newline the parsers mean (hence ``(?d)``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[\s\x1c-\x1f]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(c, fn) -> Column:
    """Evaluate a column once and use the value several times in ``fn``."""
    return F.get(F.transform(F.array(_col(c)), fn), F.lit(0))


def ws_strip(c) -> Column:
    """Strip all Unicode white space from both ends."""
    return F.regexp_replace(_col(c), rf"(?U)^{_WS}+|{_WS}+\z", "")


def first_group(c, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL when the pattern does not match."""
    c = _col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def all_groups(c, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(group))


def tag_pattern(name: str, *, flags: str = "s", attributes: bool = False) -> str:
    """Pattern of the text between ``<name>`` and ``</name>``."""
    tag = re.escape(name)
    head = rf"<{tag}\b[^>]*>" if attributes else f"<{tag}>"
    prefix = f"(?{flags})" if flags else ""
    return rf"{prefix}{head}(.*?)</{tag}>"


def tag(c, name: str, *, ignore_case: bool = False, attributes: bool = False) -> Column:
    """Stripped content of the first tag; NULL when the tag is missing."""
    flags = "is" if ignore_case else "s"
    return ws_strip(first_group(c, tag_pattern(name, flags=flags, attributes=attributes)))


def filled_tag(c, name: str, **kwargs) -> Column:
    """As :func:`tag`, but an empty tag counts as missing."""
    return bind(tag(c, name, **kwargs), lambda v: F.when(v != "", v))


def tags(c, name: str, *, ignore_case: bool = False, attributes: bool = True) -> Column:
    """Non-empty stripped contents of every tag, in order; NULL when there is none."""
    flags = "is" if ignore_case else "s"
    found = F.filter(
        F.transform(
            all_groups(c, tag_pattern(name, flags=flags, attributes=attributes)), ws_strip
        ),
        lambda x: x != "",
    )
    return F.when(F.size(found) > 0, found)


def last_match(c, pattern: str) -> Column:
    """Group 1 of the last match that is not empty, NULL when there is none."""
    return F.try_element_at(
        F.filter(all_groups(c, pattern), lambda x: x != ""), F.lit(-1)
    )


def xml_escape(c) -> Column:
    """Escape &, < and > (quotes stay)."""
    c = F.replace(_col(c), F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def squeeze(c) -> Column:
    """Collapse white space runs to one blank and strip."""
    return ws_strip(F.regexp_replace(_col(c), rf"(?U){_WS}+", " "))


_CODE_BLOCK = r"(?s)```(?:[^\n`]*)?\n?(.*?)```"


def first_code_block(c) -> Column:
    """Stripped body of the first fenced block; NULL when missing or empty."""
    return F.nullif(ws_strip(first_group(c, _CODE_BLOCK)), F.lit(""))


_FENCED = r"(?s)^\s*```[^\n]*\n(.*?)\n\s*```\s*\z"


def unfenced(c, *, required: bool) -> Column:
    """Body of a text that is one fenced block.

    A text without the fence gives NULL when the fence is required and stays
    as it is otherwise.
    """
    c = ws_strip(c)
    body = ws_strip(first_group(c, _FENCED))
    return body if required else F.coalesce(body, c)
