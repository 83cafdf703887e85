"""DuckDB SQL twins of the completion parsers (for the oracle)."""

from __future__ import annotations

from mixlab.operators.parse import FALSE_WORDS, FALSE_WORDS_EXPLAINED, LABEL_KEYS, QUESTION_KEYS, TRUE_WORDS
from mixlab.plans.oracle_fixtures import words_sql

NL = "chr(10)"


def ws(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def bars(x):
    return f"regexp_replace({x}, '^[|]+|[|]+$', '', 'g')"


def occ(x, key_sql, key_len):
    return f"CAST((strlen({x}) - strlen(replace({x}, {key_sql}, ''))) / {key_len} AS INTEGER)"


def lit(k):
    return "'" + k.replace("'", "''") + "'"


def clean_line(x):
    s = f"regexp_replace({ws(x)}, '^:+|:+$', '', 'g')"
    return bars(ws(f"regexp_replace({s}, '^[^:]*:', '')"))


def clean_expl(x):
    return bars(ws(f"regexp_replace({x}, '^[^:]*:', '')"))


def hit_sql(o, keys):
    return "CASE " + " ".join(f"WHEN {occ(o, lit(k), len(k))} = 1 THEN {lit(k)}" for k in keys) + " END"


def part_sql(o, hit, keys, n):
    return "CASE " + " ".join(f"WHEN {hit} = {lit(k)} THEN split_part({o}, {lit(k)}, {n})" for k in keys) + " END"


def qa_stages(src: str) -> str:
    """CTE chain over src(id, o) ending in qa_out(id, question, answer, rejected)."""
    return f"""s1 AS (SELECT id, o, {hit_sql('o', LABEL_KEYS)} AS hit,
                list_filter(str_split(o, '|'), lambda x: {ws('x')} <> '') AS keep, contains(o, '|') AS has_bar FROM ({src})),
s2 AS (SELECT *, {part_sql('o', 'hit', LABEL_KEYS, 1)} AS before, {part_sql('o', 'hit', LABEL_KEYS, 2)} AS after,
              len(keep) AS n, lower(keep[1]) AS low, str_split(keep[1], 'Claim: ')[2] AS claim_txt, keep[2:] AS rest FROM s1),
s3 AS (SELECT *, contains(low, 'false claim') OR contains(low, 'untrue claim') AS says_false, contains(low, 'true claim') AS says_true,
              rest[list_position(list_transform(rest, lambda x: len({words_sql('x')})),
                                 list_max(list_transform(rest, lambda x: len({words_sql('x')}))))] AS longest,
              {occ('o', NL, 1)} AS nl FROM s2),
s4 AS (SELECT id, o,
  CASE WHEN hit IS NOT NULL THEN before
       WHEN has_bar AND n = 1 AND (says_false OR says_true) THEN claim_txt
       WHEN has_bar AND n >= 2 THEN keep[1]
       WHEN NOT has_bar AND nl = 1 THEN split_part(o, {NL}, 1) END AS q_line,
  CASE WHEN hit IS NOT NULL THEN after
       WHEN has_bar AND n = 1 AND says_false THEN 'False'
       WHEN has_bar AND n = 1 AND says_true THEN 'True'
       WHEN has_bar AND n >= 2 THEN longest
       WHEN NOT has_bar AND nl = 1 THEN split_part(o, {NL}, 2) END AS a_line FROM s3),
qa_out AS (SELECT id, CASE WHEN q_line IS NOT NULL AND a_line IS NOT NULL THEN {clean_line('q_line')} END AS question,
                  CASE WHEN q_line IS NOT NULL AND a_line IS NOT NULL THEN {clean_line('a_line')} END AS answer,
                  NOT (q_line IS NOT NULL AND a_line IS NOT NULL) AS rejected FROM s4)"""


def label_sql(x, false_words):
    low = f"lower({x})"
    t = " OR ".join(f"(contains({low}, {lit(w)}) AND NOT contains({low}, {lit('not ' + w)}) AND NOT contains({low}, {lit('un' + w)}))"
                    for w in TRUE_WORDS)
    f = " OR ".join(f"contains({low}, {lit(w)})" for w in false_words)
    return f"(CASE WHEN ({t}) AND ({f}) THEN NULL WHEN ({t}) THEN 1 WHEN ({f}) THEN 0 END)"


def fv_stages(src: str) -> str:
    return qa_stages(src) + f""",
fv_l AS (SELECT id, question, CAST({label_sql('answer', FALSE_WORDS)} AS INTEGER) AS lab FROM qa_out),
fv_out AS (SELECT id, CASE WHEN question IS NOT NULL AND lab IS NOT NULL THEN question END AS claim,
                  CASE WHEN question IS NOT NULL AND lab IS NOT NULL THEN lab END AS label,
                  NOT (question IS NOT NULL AND lab IS NOT NULL) AS rejected FROM fv_l)"""


def cot_stages(src: str) -> str:
    qh = hit_sql("o", QUESTION_KEYS)
    return f"""c1 AS (SELECT id, o, {hit_sql('o', LABEL_KEYS)} AS hit, {qh} AS qhit,
                list_filter(str_split(o, '||'), lambda x: {ws('x')} <> '') AS keep, str_split(o, {NL}) AS lines,
                contains(o, '||') AS has_pipes, {occ('o', NL, 1)} = 2 AS three_nl FROM ({src})),
c2 AS (SELECT *, {part_sql('o', 'hit', LABEL_KEYS, 1)} AS expq, {part_sql('o', 'hit', LABEL_KEYS, 2)} AS a1 FROM c1),
c3 AS (SELECT *, CASE {" ".join(f"WHEN qhit = {lit(k)} THEN {occ('expq', lit(k), len(k))} = 1" for k in QUESTION_KEYS)} END AS q_in_expq,
              {part_sql('expq', 'qhit', QUESTION_KEYS, 1)} AS e_q, {part_sql('expq', 'qhit', QUESTION_KEYS, 2)} AS q_q,
              strpos({bars('expq')}, '||') = 2 AS bar_at_1, {occ('expq', "'||'", 2)} = 1 AS bar_pair FROM c2),
c4 AS (SELECT id,
  CASE WHEN hit IS NOT NULL AND qhit IS NOT NULL THEN CASE WHEN q_in_expq THEN e_q END
       WHEN hit IS NOT NULL AND bar_at_1 AND bar_pair THEN split_part(expq, '||', 1)
       WHEN hit IS NULL AND has_pipes AND len(keep) = 3 THEN keep[1]
       WHEN hit IS NULL AND NOT has_pipes AND three_nl THEN lines[1] END AS e_line,
  CASE WHEN hit IS NOT NULL AND qhit IS NOT NULL THEN CASE WHEN q_in_expq THEN q_q END
       WHEN hit IS NOT NULL AND bar_at_1 AND bar_pair THEN split_part(expq, '||', 2)
       WHEN hit IS NULL AND has_pipes AND len(keep) = 3 THEN keep[2]
       WHEN hit IS NULL AND NOT has_pipes AND three_nl THEN lines[2] END AS q_line,
  CASE WHEN hit IS NOT NULL THEN a1
       WHEN hit IS NULL AND has_pipes AND len(keep) = 3 THEN keep[3]
       WHEN hit IS NULL AND NOT has_pipes AND three_nl THEN lines[3] END AS a_line FROM c3),
cot_out AS (SELECT id, CASE WHEN e_line IS NOT NULL AND q_line IS NOT NULL AND a_line IS NOT NULL THEN {clean_expl('e_line')} END AS explanation,
                   CASE WHEN e_line IS NOT NULL AND q_line IS NOT NULL AND a_line IS NOT NULL THEN {clean_line('q_line')} END AS question,
                   CASE WHEN e_line IS NOT NULL AND q_line IS NOT NULL AND a_line IS NOT NULL THEN {clean_line('a_line')} END AS answer,
                   NOT (e_line IS NOT NULL AND q_line IS NOT NULL AND a_line IS NOT NULL) AS rejected FROM c4)"""


def cot_fv_stages(src: str) -> str:
    return cot_stages(src) + f""",
cfv_l AS (SELECT id, explanation, question, CAST({label_sql('answer', FALSE_WORDS_EXPLAINED)} AS INTEGER) AS lab FROM cot_out),
cot_fv_out AS (SELECT id, CASE WHEN question IS NOT NULL AND lab IS NOT NULL THEN explanation END AS explanation,
                      CASE WHEN question IS NOT NULL AND lab IS NOT NULL THEN question END AS claim,
                      CASE WHEN question IS NOT NULL AND lab IS NOT NULL THEN lab END AS label,
                      NOT (question IS NOT NULL AND lab IS NOT NULL) AS rejected FROM cfv_l)"""
