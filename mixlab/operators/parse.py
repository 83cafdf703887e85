"""Completion parsing (E4-E7) as column expressions.

Each parser is a cascade of ``when`` branches over built-in string
functions -- no Python UDF -- so parsing runs in codegen over any number of
rows. A completion that cannot be parsed yields NULL fields and
``rejected = true`` (the reference raises or warns); callers split parsed
rows and rejects with one filter each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlab.functions.text import strip_ws, words

# Split keys, in the order the reference tries them.
LABEL_KEYS = ["Label", "Verdict", "Fact", "Answer"]
QUESTION_KEYS = ["Question", "Claim"]
# Label words.
TRUE_WORDS = ["true", "correct", "right"]
FALSE_WORDS = ["untrue", "false", "wrong", "misleading", "inaccurate", "unsubstantiated", "unverified",
               "unsupported", "not supported", "untruth", "unthinkable"]
FALSE_WORDS_EXPLAINED = ["untrue", "false", "wrong", "misleading", "inaccurate", "unsubstantiated", "unverified"]


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def occurrences(c: Column, key: str) -> Column:
    """Non-overlapping occurrences of a literal key (byte-length arithmetic)."""
    return ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(key), F.lit("")))) / len(key.encode())).cast("int")


def strip_bars(c: Column) -> Column:
    return F.regexp_replace(c, r"^[|]+|[|]+\z", "")


def after_first_colon(c: Column) -> Column:
    return F.regexp_replace(c, r"^[^:]*:", "")


def clean_line(c: Column) -> Column:
    """strip, strip ':', drop through the first ':', strip, strip '|'."""
    s = F.regexp_replace(strip_ws(c), r"^:+|:+\z", "")
    return strip_bars(strip_ws(after_first_colon(s)))


def clean_explanation(c: Column) -> Column:
    """drop through the first ':' of the raw line, strip, strip '|'."""
    return strip_bars(strip_ws(after_first_colon(c)))


def _key_parts(df: DataFrame, o: str, keys: list[str], prefix: str) -> DataFrame:
    hit = F.coalesce(*[F.when(occurrences(F.col(o), k) == 1, F.lit(k)) for k in keys])
    d = df.withColumn(f"{prefix}hit", hit)
    h = F.col(f"{prefix}hit")
    return d.withColumns({
        f"{prefix}before": F.coalesce(*[F.when(h == k, F.substring_index(F.col(o), k, 1)) for k in keys]),
        f"{prefix}after": F.coalesce(*[F.when(h == k, F.substring_index(F.col(o), k, -1)) for k in keys]),
    })


def parse_qa(df: DataFrame, c: str, out: str = "parsed") -> DataFrame:
    """Adds ``out`` = struct(question, answer, rejected). Intermediate
    values are staged columns so no sub-expression is evaluated twice."""
    d = _key_parts(df, c, LABEL_KEYS, "_k_")
    d = d.withColumns({
        "_keep": F.filter(F.split(F.col(c), r"[|]"), lambda x: strip_ws(x) != ""),
        "_bar": F.contains(F.col(c), F.lit("|")),
        "_nl": occurrences(F.col(c), "\n"),
    })
    d = d.withColumns({"_n": F.size("_keep"), "_one": F.get(F.col("_keep"), 0),
                       "_rest": F.slice(F.col("_keep"), 2, F.greatest(F.size("_keep") - 1, F.lit(1)))})
    d = d.withColumns({
        "_low": F.lower("_one"),
        "_sizes": F.transform("_rest", lambda x: F.size(words(x))),
    })
    d = d.withColumns({
        "_sf": F.contains(F.col("_low"), F.lit("false claim")) | F.contains(F.col("_low"), F.lit("untrue claim")),
        "_st": F.contains(F.col("_low"), F.lit("true claim")),
        "_claim": F.get(F.split(F.col("_one"), "Claim: "), 1),
        "_longest": F.element_at(F.col("_rest"), F.array_position("_sizes", F.array_max("_sizes")).cast("int")),
    })
    hit, bar, n, nl = F.col("_k_hit"), F.col("_bar"), F.col("_n"), F.col("_nl")
    d = d.withColumns({
        "_ql": (F.when(hit.isNotNull(), F.col("_k_before"))
                .when(bar & (n == 1) & (F.col("_sf") | F.col("_st")), F.col("_claim"))
                .when(bar & (n >= 2), F.col("_one"))
                .when(~bar & (nl == 1), F.substring_index(F.col(c), "\n", 1))),
        "_al": (F.when(hit.isNotNull(), F.col("_k_after"))
                .when(bar & (n == 1) & F.col("_sf"), F.lit("False"))
                .when(bar & (n == 1) & F.col("_st"), F.lit("True"))
                .when(bar & (n >= 2), F.col("_longest"))
                .when(~bar & (nl == 1), F.substring_index(F.col(c), "\n", -1))),
    })
    d = d.withColumn("_ok", F.col("_ql").isNotNull() & F.col("_al").isNotNull())
    d = _emit(d, out, F.struct(F.when(F.col("_ok"), clean_line(F.col("_ql"))).alias("question"),
                               F.when(F.col("_ok"), clean_line(F.col("_al"))).alias("answer"),
                               (~F.col("_ok")).alias("rejected")))
    return d.drop(*[x for x in d.columns if x.startswith("_") and x not in df.columns and x != out])


def label_from_words(label: Column, false_words: list[str]) -> Column:
    """E5 label rule: 1 if a true word occurs (not preceded by 'not ' / 'un'),
    0 if a false word occurs (substring), NULL if both or neither."""
    low = F.lower(label)
    is_true = None
    for w in TRUE_WORDS:
        t = F.contains(low, F.lit(w)) & ~F.contains(low, F.lit("not " + w)) & ~F.contains(low, F.lit("un" + w))
        is_true = t if is_true is None else (is_true | t)
    is_false = None
    for w in false_words:
        f = F.contains(low, F.lit(w))
        is_false = f if is_false is None else (is_false | f)
    return F.when(is_true & is_false, F.lit(None)).when(is_true, F.lit(1)).when(is_false, F.lit(0)).cast("int")


def parse_fv(df: DataFrame, c: str, out: str = "parsed") -> DataFrame:
    """E5: adds ``out`` = struct(claim, label, rejected)."""
    d = parse_qa(df, c, "_qa").withColumn("_lab", label_from_words(F.col("_qa.answer"), FALSE_WORDS))
    ok = F.col("_qa.question").isNotNull() & F.col("_lab").isNotNull()
    d = _emit(d, out, F.struct(F.when(ok, F.col("_qa.question")).alias("claim"),
                               F.when(ok, F.col("_lab")).alias("label"), (~ok).alias("rejected")))
    return d.drop("_qa", "_lab")


def parse_cot_qa(df: DataFrame, c: str, out: str = "parsed") -> DataFrame:
    """Adds ``out`` = struct(explanation, question, answer, rejected)."""
    o = F.col(c)
    d = _key_parts(df, c, LABEL_KEYS, "_k_")
    d = d.withColumn("_qhit", F.coalesce(*[F.when(occurrences(o, k) == 1, F.lit(k)) for k in QUESTION_KEYS]))
    expq, qhit = F.col("_k_before"), F.col("_qhit")
    d = d.withColumns({
        "_qin": F.coalesce(*[F.when(qhit == k, occurrences(expq, k) == 1) for k in QUESTION_KEYS]),
        "_eq": F.coalesce(*[F.when(qhit == k, F.substring_index(expq, k, 1)) for k in QUESTION_KEYS]),
        "_qq": F.coalesce(*[F.when(qhit == k, F.substring_index(expq, k, -1)) for k in QUESTION_KEYS]),
        "_b1": F.instr(strip_bars(expq), "||") == 2,
        "_bp": occurrences(expq, "||") == 1,
        "_keep": F.filter(F.split(o, r"[|][|]"), lambda x: strip_ws(x) != ""),
        "_lines": F.split(o, "\n"),
        "_pipes": F.contains(o, F.lit("||")),
        "_nl2": occurrences(o, "\n") == 2,
    })
    by_key, pipes, k3, nl2 = (F.col("_k_hit").isNotNull(), F.col("_pipes"), F.size("_keep") == 3, F.col("_nl2"))
    bars_ok = F.col("_b1") & F.col("_bp")
    d = d.withColumns({
        "_el": (F.when(by_key & qhit.isNotNull(), F.when(F.col("_qin"), F.col("_eq")))
                .when(by_key & bars_ok, F.substring_index(expq, "||", 1))
                .when(~by_key & pipes & k3, F.get(F.col("_keep"), 0))
                .when(~by_key & ~pipes & nl2, F.get(F.col("_lines"), 0))),
        "_ql": (F.when(by_key & qhit.isNotNull(), F.when(F.col("_qin"), F.col("_qq")))
                .when(by_key & bars_ok, F.substring_index(expq, "||", -1))
                .when(~by_key & pipes & k3, F.get(F.col("_keep"), 1))
                .when(~by_key & ~pipes & nl2, F.get(F.col("_lines"), 1))),
        "_al": (F.when(by_key, F.col("_k_after"))
                .when(~by_key & pipes & k3, F.get(F.col("_keep"), 2))
                .when(~by_key & ~pipes & nl2, F.get(F.col("_lines"), 2))),
    })
    d = d.withColumn("_ok", F.col("_el").isNotNull() & F.col("_ql").isNotNull() & F.col("_al").isNotNull())
    ok = F.col("_ok")
    d = _emit(d, out, F.struct(F.when(ok, clean_explanation(F.col("_el"))).alias("explanation"),
                               F.when(ok, clean_line(F.col("_ql"))).alias("question"),
                               F.when(ok, clean_line(F.col("_al"))).alias("answer"), (~ok).alias("rejected")))
    return d.drop(*[x for x in d.columns if x.startswith("_") and x not in df.columns and x != out])


def parse_cot_fv(df: DataFrame, c: str, out: str = "parsed") -> DataFrame:
    """Adds ``out`` = struct(explanation, claim, label, rejected) (shorter false list)."""
    d = parse_cot_qa(df, c, "_cq").withColumn("_lab", label_from_words(F.col("_cq.answer"), FALSE_WORDS_EXPLAINED))
    ok = F.col("_cq.question").isNotNull() & F.col("_lab").isNotNull()
    d = _emit(d, out, F.struct(F.when(ok, F.col("_cq.explanation")).alias("explanation"),
                               F.when(ok, F.col("_cq.question")).alias("claim"),
                               F.when(ok, F.col("_lab")).alias("label"), (~ok).alias("rejected")))
    return d.drop("_cq", "_lab")


def _emit(d: DataFrame, out: str, struct: Column) -> DataFrame:
    """Attach the parser result through a one-element explode (a Generate
    node). Filters on the result (parsed vs rejects) then stay above it:
    otherwise predicate pushdown would inline the whole staged cascade into
    the pushed-down predicate and planning time explodes."""
    return d.select("*", F.explode(F.array(struct)).alias(out))


def yield_report(df: DataFrame, a: str, b: str) -> DataFrame:
    """Generation yield -- rows, rows missing a generated field, kept."""
    miss = F.col(a).isNull() | F.col(b).isNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(miss).alias("n_missing"),
                  F.count_if(~miss).alias("n_kept"))
