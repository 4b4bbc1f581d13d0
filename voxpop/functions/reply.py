"""Reply normalisers: turn a scorer's raw reply into a closed label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxpop import schema as S
from voxpop.functions.text import col_of, py_strip

CHAT_CONTENT_PATH = "$.choices[0].message.content"


def reply_content(reply: str | Column, path: str = CHAT_CONTENT_PATH) -> Column:
    """JSON chat reply -> content (F9); a non-JSON reply is taken as plain text."""
    r = col_of(reply)
    return F.coalesce(F.get_json_object(r, path), r)


def exact_label(reply: str | Column, labels: list[str], default: str) -> Column:
    """Stripped reply if it is one of ``labels`` else ``default`` (F7); null -> default."""
    r = py_strip(col_of(reply))
    return F.when(r.isin(*labels), r).otherwise(F.lit(default))


def contained_label(reply: str | Column, tests: list[tuple[str, str]], default: str) -> Column:
    """First ``(needle, label)`` whose needle the reply contains, else ``default`` (F8)."""
    r = col_of(reply)
    expr = None
    for needle, label in tests:
        cond = r.contains(needle)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def sentiment_from_reply(reply: str | Column) -> Column:
    """正面 -> 负面 -> 中性 precedence by containment (F8)."""
    return contained_label(reply, [("正面", "正面"), ("负面", "负面")], S.SENTIMENT_DEFAULT)


def sentiment_code(label: str | Column, default: int | None = None) -> Column:
    """Label -> code {正面:1, 中性:0, 负面:-1} (P7); ``default`` for unknown labels."""
    mapping = F.create_map(*[x for k, v in S.SENTIMENT_CODES.items() for x in (F.lit(k), F.lit(v))])
    code = F.try_element_at(mapping, col_of(label))
    return F.coalesce(code, F.lit(default)) if default is not None else code
