"""DuckDB SQL builders for the text-scoring oracles (13a tokens, n-gram
counts, BLEU, ROUGE-1, best sentence). Written independently of the Spark
plans so the oracle is a second implementation, not a transcription."""

from __future__ import annotations

from mixlab.plans.oracle_fixtures import words_sql

NL = "chr(10)"


def tok13a_sql(x: str) -> str:
    s = x
    for a, b in [("'<skipped>'", "''"), (f"'-' || {NL}", "''"), (NL, "' '"),
                 ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")]:
        s = f"replace({s}, {a}, {b})"
    s = f"(' ' || {s} || ' ')"
    for pat, rep in [(r"([{-~[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "),
                     (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")]:
        s = f"regexp_replace({s}, '{pat}', '{rep}', 'g')"
    return f"list_filter(regexp_split_to_array({s}, '\\s+'), lambda t: t <> '')"


def tokrouge_sql(x: str) -> str:
    return (f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), '\\s+'), "
            f"lambda t: t <> '')")


def grams_sql(table: str, keys: str, tok: str, max_n: int = 4) -> str:
    """(keys, n, g, c) n-gram counts of list column ``tok``."""
    return f"""SELECT {keys}, n, g, count(*) AS c FROM (
    SELECT {keys}, n, array_to_string({tok}[i:i + n - 1], ' ') AS g
    FROM (SELECT {keys}, n, {tok}, unnest(generate_series(1, len({tok}) - n + 1)) AS i
          FROM {table}, (SELECT unnest(generate_series(1, {max_n})) AS n) o)) q
  GROUP BY {keys}, n, g"""


def bleu_formula_sql(rl: str, pl: str, m: list[str]) -> str:
    order = f"least({rl}, 4)"
    precs = [f"(CASE WHEN {pl} - {k} + 1 > 0 THEN CAST({m[k-1]} AS DOUBLE) / ({pl} - {k} + 1) ELSE 0.0 END)"
             for k in range(1, 5)]
    allpos = " AND ".join(f"({order} < {k} OR {p} > 0)" for k, p in enumerate(precs, 1))
    logs = " + ".join(f"(CASE WHEN {order} >= {k} AND {p} > 0 THEN ln({p}) / {order} ELSE 0.0 END)"
                      for k, p in enumerate(precs, 1))
    bp = f"(CASE WHEN {pl} > {rl} THEN 1.0 ELSE exp(1.0 - {rl} / {pl}) END)"
    return f"(CASE WHEN {rl} > 0 AND {pl} > 0 AND {allpos} THEN {bp} * exp({logs}) ELSE 0.0 END)"


def bleu_pairs_sql(pairs_cte: str) -> str:
    """``pairs_cte`` defines pairs(pair_id, ref, pred). Returns a WITH-less
    chain of CTE definitions ending in bleu_out(pair_id, bleu)."""
    return f"""pairs AS ({pairs_cte}),
b_pairs_t AS (SELECT pair_id, ref, pred, {tok13a_sql('ref')} AS rtok, {tok13a_sql('pred')} AS ptok,
                   len({words_sql('ref')}) AS rw, len({words_sql('pred')}) AS pw FROM pairs),
b_rg AS ({grams_sql('b_pairs_t', 'pair_id', 'rtok')}),
b_pg AS ({grams_sql('b_pairs_t', 'pair_id', 'ptok')}),
b_mm AS (SELECT pair_id, {", ".join(f"sum(CASE WHEN n = {k} THEN least(b_rg.c, b_pg.c) ELSE 0 END) AS m{k}" for k in range(1, 5))}
       FROM b_rg JOIN b_pg USING (pair_id, n, g) GROUP BY pair_id),
bleu_out AS (
  SELECT pair_id,
         CASE WHEN ref IS NULL OR pred IS NULL THEN 0.0
              WHEN rw = 0 OR pw = 0 THEN CASE WHEN ref = pred THEN 1.0 ELSE 0.0 END
              ELSE {bleu_formula_sql('len(rtok)', 'len(ptok)', [f'coalesce(m{k}, 0)' for k in range(1, 5)])} END AS bleu
  FROM b_pairs_t LEFT JOIN b_mm USING (pair_id))"""


def rouge_pairs_sql(pairs_cte: str) -> str:
    return f"""rpairs AS ({pairs_cte}),
rpairs_t AS (SELECT pair_id, ref, pred, {tokrouge_sql('ref')} AS rtok, {tokrouge_sql('pred')} AS ptok,
                    len({words_sql('pred')}) AS pw FROM rpairs),
rrg AS ({grams_sql('rpairs_t', 'pair_id', 'rtok', 1)}),
rpg AS ({grams_sql('rpairs_t', 'pair_id', 'ptok', 1)}),
rmm AS (SELECT pair_id, sum(least(rrg.c, rpg.c)) AS ov FROM rrg JOIN rpg USING (pair_id, n, g) GROUP BY pair_id),
rouge_x AS (SELECT pair_id, ref, pred, pw, CAST(coalesce(ov, 0) AS DOUBLE) / greatest(len(ptok), 1) AS p,
                   CAST(coalesce(ov, 0) AS DOUBLE) / greatest(len(rtok), 1) AS r
            FROM rpairs_t LEFT JOIN rmm USING (pair_id)),
rouge_out AS (SELECT pair_id, CASE WHEN pw = 0 THEN CASE WHEN ref = pred THEN 1.0 ELSE 0.0 END
                                   WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS rouge1 FROM rouge_x)"""


def best_sentence_sql(src_cte: str) -> str:
    """``src_cte`` defines src(id, ctx, v, variant, pred); ends in best_out(id, variant,
    location, location_ratio, bleu)."""
    return f"""src AS ({src_cte}),
ctxs AS (SELECT DISTINCT id, ctx FROM src),
pieces AS (SELECT id, n_pieces, s - 1 AS s, parts[s] AS ref
           FROM (SELECT id, str_split(ctx, '.') AS parts, len(str_split(ctx, '.')) AS n_pieces,
                        unnest(generate_series(1, len(str_split(ctx, '.')))) AS s FROM ctxs WHERE ctx IS NOT NULL) x),
refs AS (SELECT id, s, ref, {tok13a_sql('ref')} AS rtok, len({words_sql('ref')}) AS rw FROM pieces),
preds AS (SELECT id, v, variant, pred, {tok13a_sql('pred')} AS ptok, len({words_sql('pred')}) AS pw FROM src),
rg AS ({grams_sql('refs', 'id, s', 'rtok')}),
pg AS ({grams_sql('preds', 'id, v', 'ptok')}),
mm AS (SELECT id, s, v, {", ".join(f"sum(CASE WHEN n = {k} THEN least(rg.c, pg.c) ELSE 0 END) AS m{k}" for k in range(1, 5))}
       FROM rg JOIN pg USING (id, n, g) GROUP BY id, s, v),
cand AS (SELECT mm.id, mm.v, mm.s, {bleu_formula_sql('len(refs.rtok)', 'len(preds.ptok)', ['m1', 'm2', 'm3', 'm4'])} AS bleu
         FROM mm JOIN refs ON refs.id = mm.id AND refs.s = mm.s JOIN preds ON preds.id = mm.id AND preds.v = mm.v
         WHERE refs.rw > 0 AND preds.pw > 0
         UNION ALL
         SELECT preds.id, preds.v, refs.s, 1.0 FROM preds JOIN refs ON refs.id = preds.id
         WHERE preds.pred IS NOT NULL AND preds.pw = 0 AND refs.ref = preds.pred),
ranked AS (SELECT id, v, s, bleu, row_number() OVER (PARTITION BY id, v ORDER BY bleu DESC, s) AS rn
           FROM cand WHERE bleu > 0),
np AS (SELECT DISTINCT id, n_pieces FROM pieces),
best_out AS (
  SELECT p.id, p.variant,
         CASE WHEN np.n_pieces IS NULL THEN NULL ELSE CAST(coalesce(r.s, 0) AS BIGINT) END AS location,
         CAST(coalesce(r.s, 0) AS DOUBLE) / np.n_pieces AS location_ratio,
         CASE WHEN np.n_pieces IS NULL THEN NULL ELSE coalesce(r.bleu, 0.0) END AS bleu
  FROM preds p LEFT JOIN ranked r ON r.id = p.id AND r.v = p.v AND r.rn = 1
  LEFT JOIN np ON np.id = p.id)"""
