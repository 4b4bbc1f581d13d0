"""Column functions for text: Python-compatible strip, code-point slicing, factor lists.

All of these are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxpop import schema as S

# Characters Python's ``str.strip()`` removes (str.isspace): ASCII controls
# \t..\r and \x1c..\x1f, space, NEL, NBSP and the Unicode space separators.
PY_SPACE_CLASS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


PY_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c: str | Column) -> Column:
    """Python ``str.strip()`` (P2/F1): ``trim`` with Python's whitespace set, which only
    looks at the two ends (plain ``trim`` removes ASCII spaces only)."""
    return F.trim(col_of(c), F.lit(PY_SPACE_CHARS))


def strip_chars(c: str | Column, chars: str) -> Column:
    """Python ``str.strip(chars)`` for a literal character set (F2)."""
    cls = "[" + "".join("\\" + ch if ch in "\\]^-[" else ch for ch in chars).replace("\n", "\\n") + "]"
    return F.regexp_replace(col_of(c), f"\\A{cls}+|{cls}+\\z", "")


def null_to_blank(c: str | Column) -> Column:
    """``fillna('').astype(str)``."""
    return F.coalesce(col_of(c).cast("string"), F.lit(""))


def normalized(c: str | Column) -> Column:
    """P1 then P2: the text the scorers see before truncation."""
    return py_strip(null_to_blank(c))


def is_blank(c: str | Column) -> Column:
    """P3 blank guard: null, empty or only whitespace."""
    return normalized(c) == F.lit("")


def truncate(c: str | Column, n: int = S.SCORE_TEXT_LIMIT) -> Column:
    """First ``n`` code points."""
    return F.substring(col_of(c), 1, n)


def preview(c: str | Column, n: int = S.PREVIEW_LIMIT) -> Column:
    """First ``n`` code points plus ``...`` only when longer (P5)."""
    c = col_of(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def split_factors(reply: str | Column, min_len: int = S.FACTOR_MIN_LEN, max_len: int = S.FACTOR_MAX_LEN) -> Column:
    """Factor reply -> list (F5 + P14): full-width comma to comma, split, strip, keep 2..5 code points.

    A null reply gives an empty list.
    """
    parts = F.split(F.translate(F.coalesce(col_of(reply), F.lit("")), "，", ","), ",")
    stripped = F.transform(parts, lambda x: py_strip(x))
    return F.filter(stripped, lambda x: (F.length(x) >= min_len) & (F.length(x) <= max_len))


def or_default_list(arr: str | Column, default: str = S.FACTOR_NONE) -> Column:
    """``list or [default]``."""
    arr = col_of(arr)
    return F.when(F.size(arr) > 0, arr).otherwise(F.array(F.lit(default)))


def join_factors(arr: str | Column) -> Column:
    """``'，'.join(list)``."""
    return F.array_join(col_of(arr), S.FACTOR_SEPARATOR)


def percent_text(x: str | Column, decimals: int = 2) -> Column:
    """``f'{x:.2%}'`` (F12): half-even like Python; no grouping separators below 1000%."""
    return F.concat(F.format_number(col_of(x) * 100.0, decimals), F.lit("%"))


def safe_div(num: str | Column, den: str | Column) -> Column:
    """``a / b if b > 0 else 0`` (F13), as double."""
    num, den = col_of(num), col_of(den)
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def round_even(x: str | Column, places: int = 4) -> Column:
    """Python ``round(x, n)`` (F14): half to even on the binary value, not on its decimal text
    (``bround`` takes 0.12345 for a tie; the double lies above it)."""
    pattern = "0." + "0" * places if places else "0"
    return F.call_function("format_number", col_of(x).cast("double"), F.lit(pattern)).cast("double")


def fill_template(template: str, c: str | Column, limit: int | None = S.SCORE_TEXT_LIMIT,
                  **slots: str | Column) -> Column:
    """``template.format(text[:limit], **slots)`` (F16) as a concat of literals and columns.

    ``{}`` or ``{text}`` is the text; every other ``{name}`` needs a slot. Nulls
    print as ``nan`` like the reference's pandas.
    """
    body = truncate(c, limit) if limit else col_of(c)
    values = {"": body, "text": body, **{k: col_of(v) for k, v in slots.items()}}
    parts, used = [], set()
    for literal, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(literal))
        if name is not None:
            if name not in values:
                raise ValueError(f"template slot {{{name}}} has no column")
            used.add(name)
            parts.append(F.coalesce(values[name], F.lit("nan")))
    if not used & {"", "text"}:
        raise ValueError("template needs a '{}' or '{text}' placeholder")
    return F.concat(*parts)


def group_key(a: str | Column, b: str | Column) -> Column:
    """``f'{a}-{b}'`` (F15); a null prints as ``nan`` like the reference's pandas."""
    return F.concat(F.coalesce(col_of(a), F.lit("nan")), F.lit("-"), F.coalesce(col_of(b), F.lit("nan")))
