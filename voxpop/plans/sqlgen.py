"""Small helpers to state the oracle SQL (DuckDB dialect) from the same fixed values.

The oracle is an independent formulation of each query in plain SQL; only the
literal rule tables are shared so both sides test the same labels and cues.
"""

from __future__ import annotations

from voxpop import schema as S


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


NORM = "regexp_replace(coalesce({c}, ''), '^[\\s\u3000]+|[\\s\u3000]+$', '', 'g')"


def norm(col: str) -> str:
    return NORM.format(c=col)


def rule_case(t: S.Taxonomy, text_sql: str, blank_sql: str | None = None) -> str:
    parts = ["CASE"]
    if blank_sql:
        parts.append(f"WHEN {blank_sql} THEN {q(t.default)}")
    for label, words in t.cues:
        any_of = " OR ".join(f"contains({text_sql}, {q(w)})" for w in words)
        parts.append(f"WHEN {any_of} THEN {q(label)}")
    parts.append(f"ELSE {q(t.default)} END")
    return " ".join(parts)


def labelled_case(t: S.Taxonomy, col: str = "text") -> str:
    n = norm(col)
    return rule_case(t, n, f"{n} = ''")


def values_dim(t: S.Taxonomy) -> str:
    rows = ", ".join(f"({q(lab)}, {i})" for i, lab in enumerate(t.categories))
    return f"(SELECT * FROM (VALUES {rows}) v(label, ordinal))"


def map_case(col: str, pairs: list[tuple[str, str]]) -> str:
    whens = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in pairs)
    return f"CASE {col} {whens} END"
