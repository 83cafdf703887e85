"""Column expressions for BLEU / ROUGE tokenisation and the BLEU formula.

Fixed values below follow the public mteval-13a tokeniser used by the
reference's BLEU metric (Papineni et al. 2002, smoothing off, max order 4)
and the default ROUGE tokeniser (lower-case, ``[^a-z0-9]+`` -> space).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mixlab.functions.text import WS

MAX_ORDER = 4

# 13a pre-replacements, in order.
T13A_REPLACE = [("<skipped>", ""), ("-\n", ""), ("\n", " "),
                ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
# 13a regex rules (pattern, Java replacement), applied in order. The first class starts behind the
# space: one space parts tokens as well as the three that the original rule makes of it, at a fraction of the time.
T13A_RULES = [
    (r"([\{-\~\[-\`\!-\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
ROUGE_STRIP = r"[^a-z0-9]+"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def tokens_13a(c: str | Column) -> Column:
    x = _c(c)
    for a, b in T13A_REPLACE:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for pat, rep in T13A_RULES:
        x = F.regexp_replace(x, pat, rep)
    return F.array_remove(F.split(x, WS), "")


def tokens_rouge(c: str | Column) -> Column:
    x = F.regexp_replace(F.lower(_c(c)), ROUGE_STRIP, " ")
    return F.array_remove(F.split(x, WS), "")


def bleu_sql(rl: str, pl: str, m: list[str]) -> str:
    """BLEU from counts as a SQL expression (one analyzer round trip
    instead of hundreds of Column calls when plans are built)."""
    order = f"least({rl}, {MAX_ORDER})"
    precs = [f"(CASE WHEN {pl} - {k} + 1 > 0 THEN CAST({m[k - 1]} AS DOUBLE) / ({pl} - {k} + 1) ELSE 0.0D END)"
             for k in range(1, len(m) + 1)]
    allpos = " AND ".join(f"({order} < {k} OR {p} > 0)" for k, p in enumerate(precs, 1))
    logs = " + ".join(f"(CASE WHEN {order} >= {k} AND {p} > 0 THEN ln({p}) / {order} ELSE 0.0D END)"
                      for k, p in enumerate(precs, 1))
    bp = f"(CASE WHEN {pl} > {rl} THEN 1.0D ELSE exp(1.0D - {rl} / {pl}) END)"
    return f"(CASE WHEN {rl} > 0 AND {pl} > 0 AND {allpos} THEN {bp} * exp({logs}) ELSE 0.0D END)"
