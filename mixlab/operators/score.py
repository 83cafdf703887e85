"""Text-pair scoring jobs: pairwise BLEU (E1), best evidence sentence (E2),
ROUGE-1 (F9).

Plan shape (one shuffle): the input is spread by ``id`` once, then every row
is scored on its own by array functions: the grams of every text variant
(prediction) and of every dot piece of the context (reference) are arrays, the
n-th repeat of a gram is marked as such, and the clipped matches of a piece and
a variant are the size of an intersection. Only a piece that shares a gram of
its highest order with a variant is counted. No gram leaves its row, so neither
shuffles, spills nor aggregates grow with the grams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlab.functions.bleu import MAX_ORDER, bleu_sql, tokens_13a, tokens_rouge
from mixlab.functions.text import dot_pieces, words


def _keys(id_col: str | Sequence[str]) -> list[str]:
    return [id_col] if isinstance(id_col, str) else list(id_col)


def _by_id(df: DataFrame, id_col: str, partitions: int | None = None) -> DataFrame:
    """Hash-partition on ``id`` with an explicit partition count. The input is
    small in bytes but expands ~20x into grams, so AQE must not coalesce this
    exchange by its input size (REPARTITION_BY_NUM is left as requested)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, id_col)


def _let_sql(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` bound to ``name``: within a lambda it is computed once, not at every use."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _grams_sql(tok: str, n: int) -> str:
    """The n-grams of a token array, joined by spaces: overlapping matches in its text, which takes half the time of slices."""
    if n == 1:
        return tok
    gram = r"(?<!\S)(?=(" + " ".join([r"\S++"] * n) + "))"
    return f"regexp_extract_all(array_join({tok}, ' '), r'{gram}', 1)"


def _numbered_sql(grams: str) -> str:
    """Grams with the repeats of each marked by their number behind two spaces (a gram has single ones), so
    that the clipped matches of two texts are the size of the intersection of their sets."""
    marked = ("flatten(transform(_b_, (_a_, _j_) -> transform(sequence(0, coalesce(get(_b_, _j_ + 1), size(_s_)) - _a_ - 1), "
              "_o_ -> CASE WHEN _o_ = 0 THEN get(_s_, _a_) ELSE concat(get(_s_, _a_), '  ', CAST(_o_ AS STRING)) END)))")
    starts = "filter(sequence(0, size(_s_) - 1), _i_ -> _i_ = 0 OR get(_s_, _i_) <> get(_s_, _i_ - 1))"
    repeats = _let_sql("sort_array(_g_)", "_s_", _let_sql(starts, "_b_", marked))
    return _let_sql(grams, "_g_", f"CASE WHEN size(array_distinct(_g_)) = size(_g_) THEN _g_ ELSE {repeats} END")


def _orders_sql(tok: str, max_n: int) -> str:
    return "array(" + ", ".join(_numbered_sql(_grams_sql(tok, n)) for n in range(1, max_n + 1)) + ")"


def _scores_sql(max_n: int, scorer) -> str:
    """Per piece of ``_ptoks`` the scores of all variants (``_texts``: their tokens, ``_grams``: per order their
    numbered grams), NULL if all are 0. The scores have no smoothing, so a piece without a common gram of its highest order
    (``max_n``, or its length if shorter) scores 0; single tokens are compared first, as they cost no grams."""
    top = f"least(size(_t_), {max_n}) - 1"
    matches = [f"size(array_intersect(get(get(_grams, _k_), {n - 1}), get(_r_, {n - 1})))" for n in range(1, max_n + 1)]
    counts = "named_struct(" + ", ".join(f"'m{n}', {m}" for n, m in enumerate(matches, 1)) + ")"
    score = scorer("size(_t_)", "size(_x_)", [f"_m_.m{n}" for n in range(1, max_n + 1)])
    scored = (f"transform(_texts, (_x_, _k_) -> CASE WHEN get(_near_, _k_) THEN {_let_sql(counts, '_m_', score)} ELSE 0.0D END)")
    orders = _orders_sql("_t_", max_n)
    near = f"transform(_texts, (_x_, _k_) -> arrays_overlap(_t_, _x_) AND arrays_overlap(_h_, get(get(_grams, _k_), {top})))"
    some = _let_sql(near, "_near_", f"CASE WHEN exists(_near_, _y_ -> _y_) THEN {_let_sql(orders, '_r_', scored)} END")
    highest = f"CASE WHEN size(_t_) >= {max_n} THEN {_grams_sql('_t_', max_n)} ELSE array(array_join(_t_, ' ')) END"
    shares = "exists(_texts, _x_ -> arrays_overlap(_t_, _x_))"
    piece = f"CASE WHEN size(_t_) > 0 AND {shares} THEN {_let_sql(highest, '_h_', some)} END"
    return f"transform(_ptoks, _t_ -> {piece})"


def _score(df: DataFrame, keep: Sequence[str], pieces: Column, preds: Sequence[Column], tokenizer, max_n: int,
           scorer) -> DataFrame:
    """The columns ``keep`` and per row ``_np`` (pieces, NULL for a NULL context), and per variant k ``_pw{k}``
    (words, -1 for NULL), ``_el{k}`` (first equal piece or -1, NULL for a NULL text) and ``b{k}`` = struct(s, score) of the best
    positive piece (first wins ties), NULL if there is none."""
    K = range(len(preds))
    none = F.array().cast("array<string>")
    tok = df.select(*keep, pieces.alias("_pieces"), F.transform(pieces, tokenizer).alias("_ptoks"), *[p.alias(f"_q{k}") for k, p in enumerate(preds)],
                    F.array(*[F.coalesce(tokenizer(p), none) for p in preds]).alias("_texts"))
    # made once a row: behind a generator the optimizer does not move them into the lambdas that use them
    once = lambda d, sql, name: d.select("*", F.explode(F.array(F.expr(sql))).alias(name))
    tok = once(tok, f"transform(_texts, _x_ -> {_orders_sql('_x_', max_n)})", "_grams")
    tok = once(tok, _scores_sql(max_n, scorer), "_scores").drop("_grams", "_texts", "_ptoks")
    tok = once(tok, f"transform(sequence(0, {len(preds) - 1}), _k_ -> transform(_scores, _y_ -> coalesce(get(_y_, _k_), 0.0D)))", "_of").drop("_scores")
    safe = F.coalesce("_pieces", none)
    best = lambda k: (f"CASE WHEN array_max(_of[{k}]) > 0 THEN named_struct('s', CAST(array_position(_of[{k}], array_max(_of[{k}])) - 1 AS INT), "  # noqa: E731
                      f"'score', array_max(_of[{k}])) END")
    return tok.select(*keep, F.size("_pieces").alias("_np"), *[F.coalesce(F.size(words(f"_q{k}")), F.lit(-1)).alias(f"_pw{k}") for k in K],
                      *[(F.array_position(safe, F.col(f"_q{k}")) - 1).cast("int").alias(f"_el{k}") for k in K], *[F.expr(best(k)).alias(f"b{k}") for k in K])


def best_sentence(df: DataFrame, variants: dict[str, str], context: str = "context",
                  id_col: str | Sequence[str] = "id", wide: bool = False) -> DataFrame:
    """For each text variant, the dot piece of ``context`` it matches best.

    Output (id, variant, location, location_ratio, bleu). Each piece is the
    BLEU *reference* and the text the *prediction*; the first piece wins
    ties; with no piece above 0 the answer is (0, 0.0, 0.0); a text without
    words scores 1 only on a piece equal to it; NULL context -> NULL. Rows that
    share an id are scored apart, one answer per row and variant. ``wide``: the rows of
    ``df`` as they are, with the columns ``<variant>_best_bleu``, ``_location`` and ``_location_ratio`` of each variant.
    """
    ids = _keys(id_col)
    texts = [F.col(c).cast("string") for c in variants.values()]
    keep = df.columns if wide else ids
    r = _score(_by_id(df if wide else df.select(*dict.fromkeys([*ids, context, *variants.values()])), ids[0]),
               keep, dot_pieces(context), texts, tokens_13a, MAX_ORDER, bleu_sql)
    answers = {}
    for k, n in enumerate(variants):
        nullctx = F.col("_np").isNull()
        empty_hit = (F.col(f"_pw{k}") == 0) & (F.col(f"_el{k}") >= 0)
        loc = (F.when(nullctx, F.lit(None)).when(empty_hit, F.col(f"_el{k}"))
               .otherwise(F.coalesce(F.col(f"b{k}.s"), F.lit(0))))
        bleu = (F.when(nullctx, F.lit(None)).when(empty_hit, F.lit(1.0))
                .when(F.col(f"_pw{k}") == 0, F.lit(0.0))
                .otherwise(F.coalesce(F.col(f"b{k}.score"), F.lit(0.0))))
        answers[n] = (loc.cast("long"), loc.cast("double") / F.col("_np"), bleu.cast("double"))
    if wide:
        names = ("location", "location_ratio", "best_bleu")
        return r.select(*keep, *[c.alias(f"{n}_{f}") for n, cells in answers.items() for f, c in zip(names, cells)])
    rows = [F.struct(F.lit(n).alias("variant"), loc.alias("location"), ratio.alias("location_ratio"), bleu.alias("bleu"))
            for n, (loc, ratio, bleu) in answers.items()]
    return r.select(*ids, F.inline(F.array(*rows)))


def _pair_score(df: DataFrame, ref: str, pred: str, id_col: str | Sequence[str], tokenizer, max_n: int, scorer, name: str,
                wide: bool = False) -> DataFrame:
    ids = _keys(id_col)
    keep = df.columns if wide else ids
    base = df if wide else _by_id(df.select(*dict.fromkeys([*ids, ref, pred])), ids[0])  # wide: rows stay where they are
    r = _score(base, keep, F.array(F.col(ref)), [F.col(pred)], tokenizer, max_n, scorer)
    null_side = F.col("_el0").isNull()  # NULL prediction
    # the reference text is the single piece: a prediction without words
    # scores 1 only when equal to it; a NULL reference never matches
    out = (F.when(null_side, F.lit(0.0))
           .when(F.col("_pw0") == 0, F.when(F.col("_el0") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
           .otherwise(F.coalesce(F.col("b0.score"), F.lit(0.0))))
    return r.select(*keep, out.alias(name))


def bleu_pairs(df: DataFrame, ref: str = "ref", pred: str = "pred", id_col: str | Sequence[str] = "pair_id", wide: bool = False) -> DataFrame:
    """(id, ref, pred) -> (id, bleu).

    NULL side -> 0; a side without words -> 1 if the strings are equal else 0;
    otherwise BLEU-min(ref_len,4) with brevity penalty. The pair is a
    one-piece context, so E1 runs E2's single-shuffle plan. ``wide``: the rows of ``df`` as they
    are, with the column ``bleu``, and no shuffle.
    """
    return _pair_score(df, ref, pred, id_col, tokens_13a, MAX_ORDER, bleu_sql, "bleu", wide)


def _rouge_f(rl: str, pl: str, m: list[str]) -> str:
    p = f"(CAST({m[0]} AS DOUBLE) / greatest({pl}, 1))"
    r = f"(CAST({m[0]} AS DOUBLE) / greatest({rl}, 1))"
    return f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0D END)"


def rouge1_pairs(df: DataFrame, ref: str = "ref", pred: str = "pred", id_col: str | Sequence[str] = "pair_id") -> DataFrame:
    """ROUGE-1 F-measure per pair (clipped unigram overlap on the default
    ROUGE tokens). A prediction without words scores 1 if equal else 0."""
    return _pair_score(df, ref, pred, id_col, tokens_rouge, 1, _rouge_f, "rouge1")


def vector_match_f1(vecs: DataFrame, pair: str = "pair_id", side: str = "side", pos: str = "pos",
                    vector: str = "vector", cand_side: int = 0) -> DataFrame:
    """Greedy token-vector matching (precision / recall / F1 of max
    cosine similarities, Zhang et al. 2020) for each text pair.

    The token vectors of one pair are gathered into two arrays (bounded by
    the pair's text lengths) and the similarity matrix is computed inside the
    row with array functions -- no row explosion, no pairwise join."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = lambda v: F.transform(v, lambda x: x / norm(v))
    toks = vecs.select(pair, side, pos, unit(F.col(vector)).alias("_u"))
    g = toks.groupBy(pair).agg(
        F.array_sort(F.collect_list(F.when(F.col(side) == cand_side, F.struct(pos, "_u")))).alias("_c"),
        F.array_sort(F.collect_list(F.when(F.col(side) != cand_side, F.struct(pos, "_u")))).alias("_r"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def best(xs, ys):
        return F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: dot(x["_u"], y["_u"]))))

    def mean(arr):
        return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x) / F.size(arr)

    both = (F.size("_c") > 0) & (F.size("_r") > 0)  # a pair with an empty side scores 0
    g = g.select(pair, F.when(both, mean(best(F.col("_c"), F.col("_r")))).otherwise(0.0).alias("precision"),
                 F.when(both, mean(best(F.col("_r"), F.col("_c")))).otherwise(0.0).alias("recall"))
    return g.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                        .otherwise(F.lit(0.0)))
