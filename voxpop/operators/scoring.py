"""Batch scoring (U1-U3, U6, P3, J1): label every post with a closed-set label.

Two kinds of scorer:

* built-in rules (a :class:`Taxonomy`): pure column expressions, no Python stage;
* a pluggable scorer ``Callable[[pandas.Series], pandas.Series]`` (prompt -> raw
  reply), run as an iterator pandas UDF: only the prompt goes to Python, in calls
  of at most ``CALL_ROWS`` prompts. Replies are normalised by Spark expressions
  afterwards. A failing call is retried row by row; a failing row gets a null
  reply (hence the default label) and its error text in ``score_error``, so one
  bad row never fails the job nor repeats more than one call.

Blank rows (P3) never reach a scorer: they are split off before and unioned
back after. A scorer may be paid for or random: write a scored table (K2, or
``session.materialize``) before several outputs read it.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxpop import schema as S
from voxpop.functions import reply as R
from voxpop.functions import text as X
from voxpop.operators.calls import score_batches

Scorer = Callable[[pd.Series], pd.Series]


#: Up to so many words are searched one by one, which is faster than one regular expression.
FEW_WORDS = 4


def rule_label(text: str | Column, taxonomy: S.Taxonomy) -> Column:
    """First rule (in ordinal order) whose pattern the text matches, else the default."""
    t = X.col_of(text)
    expr = None
    if taxonomy.cues and all(0 < len(words) <= FEW_WORDS for _, words in taxonomy.cues):
        conds = [(label, reduce(operator.or_, map(t.contains, words))) for label, words in taxonomy.cues]
    else:
        conds = [(label, t.rlike(pattern)) for label, pattern in taxonomy.rules()]
    for label, cond in conds:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(taxonomy.default)) if expr is not None else F.lit(taxonomy.default)


def label_with_rules(df: DataFrame, taxonomy: S.Taxonomy, text_col: str = "text", out_col: str | None = None,
                     limit: int | None = None) -> DataFrame:
    """Rule scorer over the whole stripped text (or its first ``limit`` code points); blank rows get the default label.

    Adds ``<out_col>`` and ``is_blank``. Narrow projection: one pass, no shuffle.
    """
    out_col = out_col or taxonomy.name
    norm = X.normalized(text_col)
    return (
        df.withColumn("_norm", norm)
        .withColumn("is_blank", F.col("_norm") == "")
        .withColumn(out_col, F.when(F.col("is_blank"), F.lit(taxonomy.default))
                    .otherwise(rule_label(X.truncate("_norm", limit) if limit else "_norm", taxonomy)))
        .drop("_norm")
    )


#: Most prompts in one call of a scorer.
CALL_ROWS = 64


@dataclass(frozen=True)
class Patience:
    """How long to wait for a scorer, in seconds, and when to try again.

    ``limit``: longest wait for one call (None: for ever). A failed or late call is
    repeated ``retries`` times, after pauses of ``pause``, 2 ``pause``, 4 ``pause``, ...
    After ``give_up`` rows in a row without a reply a task stops calling: its other
    rows get an error without a call (None: it never stops).
    ``at_once``: calls that a task waits for side by side, so that late ones cost
    one wait, not one each; the scorer must allow it. ``rows_at_once``: so many rows
    of failed calls besides (None: they take the places of whole calls). With
    ``give_up`` the order of the replies counts, so calls go one after the other.

    With a limit, or side by side, calls run in child processes of the task (see
    ``calls``): what a scorer changes in memory is lost with them.
    """

    limit: float | None = None
    retries: int = 0
    pause: float = 1.0
    give_up: int | None = None
    at_once: int = 1
    rows_at_once: int | None = None

    def __post_init__(self) -> None:
        if self.at_once < 1 or self.at_once > 1 and self.give_up is not None:
            raise ValueError("at_once must be 1 or more, and 1 with give_up")
        if self.rows_at_once is not None and (self.rows_at_once < 1 or self.give_up is not None):
            raise ValueError("rows_at_once must be 1 or more, and None with give_up")


def score_replies(df: DataFrame, scorer: Scorer, prompt: Column, call_rows: int = CALL_ROWS, patience: Patience = Patience()) -> DataFrame:
    """Run a pluggable scorer on ``prompt``; adds ``_reply`` and ``score_error`` (strings). Failures stay per row.

    A call that fails or exceeds ``patience`` is retried row by row; a row without a reply keeps its error.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for replies, errors in score_batches(batches, scorer, call_rows, patience):
            yield pd.DataFrame({"reply": pd.Series(replies, dtype=object), "error": pd.Series(errors, dtype=object)})

    scored = F.pandas_udf(run, "reply string, error string").asNondeterministic()
    return (df.withColumn("_scored", scored(prompt)).withColumn("_reply", F.col("_scored.reply"))
            .withColumn("score_error", F.col("_scored.error")).drop("_scored"))


def label_with_scorer(df: DataFrame, scorer: Scorer, taxonomy: S.Taxonomy, text_col: str = "text",
                      out_col: str | None = None, template: str = "{}", match: str = "exact",
                      dedupe: bool = False, limit: int | None = S.SCORE_TEXT_LIMIT, call_rows: int = CALL_ROWS,
                      patience: Patience = Patience()) -> DataFrame:
    """Pluggable scorer path of U1/U2.

    ``match='exact'``: stripped reply must equal a label (demand, F7);
    ``match='contains'``: containment tests in category order (sentiment, F8).
    ``dedupe=True`` scores each distinct prompt once and joins the reply back
    (only for deterministic scorers).
    """
    out_col = out_col or taxonomy.name
    base = df.withColumn("_norm", X.normalized(text_col)).withColumn("is_blank", F.col("_norm") == "")
    blank = (base.where("is_blank").withColumn("_reply", F.lit(None).cast("string"))
             .withColumn("score_error", F.lit(None).cast("string")))
    todo = base.where(~F.col("is_blank"))
    prompt = X.fill_template(template, "_norm", limit)
    if dedupe:
        keyed = todo.withColumn("_p", prompt)
        uniq = keyed.select("_p").distinct()
        scored_u = score_replies(uniq, scorer, F.col("_p"), call_rows, patience)
        scored = keyed.join(scored_u, "_p", "left").drop("_p")
    else:
        scored = score_replies(todo, scorer, prompt, call_rows, patience)
    out = scored.unionByName(blank)
    content = R.reply_content("_reply")
    if match == "exact":
        label = R.exact_label(content, taxonomy.categories, taxonomy.default)
    else:
        tests = [(lab, lab) for lab in taxonomy.categories if lab != taxonomy.default]
        label = R.contained_label(content, tests, taxonomy.default)
    return out.withColumn(out_col, F.when(F.col("is_blank"), F.lit(taxonomy.default)).otherwise(label)).drop(
        "_norm", "_reply")


# --------------------------------------------------------------------------- factors

def cue_reply(text: str | Column, cues: list[tuple[str, str]]) -> Column:
    """Built-in factor scorer: dictionary cues found in the whole text, mapped to factor names,
    distinct in order of first appearance, joined by '，'."""
    pattern = S.literal_trie([c for c, _ in cues])
    cue_map = F.create_map(*[x for c, f in cues for x in (F.lit(c), F.lit(f))])
    found = F.regexp_extract_all(X.col_of(text), F.lit(pattern), 0)
    names = F.transform(found, lambda m: F.try_element_at(cue_map, m))
    return X.join_factors(F.array_distinct(names))


def extract_factors(df: DataFrame, text_col: str = "text", cues: list[tuple[str, str]] | None = None,
                    scorer: Scorer | None = None, template: str = "{}", max_factors: int | None = None,
                    slots: dict[str, str] | None = None, patience: Patience = Patience()) -> DataFrame:
    """One row -> list of 1..n factors (of those with a usable length, the first ``max_factors`` if given).

    ``slots`` names further columns for the template, e.g. ``{"demand":
    "demand", "sentiment": "sentiment"}`` for ``{demand}`` and ``{sentiment}``.

    The reply (built-in cue dictionary, or a pluggable scorer) is parsed by F5 +
    P14; nothing usable -> ``[无法提取]``; a scorer error -> ``[API错误]``.
    Null texts are kept: the factor table marks them as error rows (P13).
    Adds ``factors ARRAY<STRING>``, ``n_factors`` and ``score_error``.
    """
    if scorer is None:
        reply = cue_reply(F.col(text_col), cues or S.FACTOR_CUES)
        out = df.withColumn("_reply", reply).withColumn("score_error", F.lit(None).cast("string"))
    else:
        good = df.where(F.col(text_col).isNotNull())
        bad = (df.where(F.col(text_col).isNull()).withColumn("_reply", F.lit(None).cast("string"))
               .withColumn("score_error", F.lit(None).cast("string")))
        out = score_replies(good, scorer, X.fill_template(template, text_col, None, **(slots or {})), patience=patience).unionByName(bad)
        out = out.withColumn("_reply", R.reply_content("_reply"))
    usable = X.split_factors("_reply")
    parsed = X.or_default_list(F.slice(usable, 1, max_factors) if max_factors else usable, S.FACTOR_NONE)
    factors = F.when(F.col("score_error").isNotNull(), F.array(F.lit(S.FACTOR_ERROR))).otherwise(parsed)
    return (out.withColumn("factors", factors)
            .withColumn("n_factors", F.size("factors"))
            .drop("_reply"))
