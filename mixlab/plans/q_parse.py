"""Registered completion-parsing queries."""

from __future__ import annotations

from mixlab.operators import parse as ps
from mixlab.plans.registry import register
from mixlab.plans.sql_parse import cot_fv_stages, cot_stages, fv_stages, qa_stages
from mixlab.sources import fixtures as fx
from mixlab.sources.tables import Tables

SRC = "SELECT id, completion AS o FROM fx_completions"
SRC_X = "SELECT id, completion AS o FROM fx_completions_x"


def _comp(spark, sf, explained=False):
    return fx.fx_completions(Tables(spark, sf), explained=explained)


@register("parse_qa", sql="WITH " + qa_stages(SRC) + "\nSELECT id, question, answer, rejected FROM qa_out",
          fx=["fx_completions"])
def q_parse_qa(spark, sf):
    return ps.parse_qa(_comp(spark, sf), "completion", "p").select("id", "p.*")


@register("parse_fv", sql="WITH " + fv_stages(SRC) + "\nSELECT id, claim, label, rejected FROM fv_out",
          fx=["fx_completions"])
def q_parse_fv(spark, sf):
    return ps.parse_fv(_comp(spark, sf), "completion", "p").select("id", "p.*")


@register("parse_cot_qa", sql="WITH " + cot_stages(SRC_X) + "\nSELECT id, explanation, question, answer, rejected FROM cot_out",
          fx=["fx_completions_x"])
def q_parse_cot_qa(spark, sf):
    return ps.parse_cot_qa(_comp(spark, sf, True), "completion", "p").select("id", "p.*")


@register("parse_cot_fv", sql="WITH " + cot_fv_stages(SRC_X) + "\nSELECT id, explanation, claim, label, rejected FROM cot_fv_out",
          fx=["fx_completions_x"])
def q_parse_cot_fv(spark, sf):
    return ps.parse_cot_fv(_comp(spark, sf, True), "completion", "p").select("id", "p.*")


@register("yield_report", sql="WITH " + fv_stages(SRC) + """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE claim IS NULL OR label IS NULL) AS n_missing,
       count(*) FILTER (WHERE NOT (claim IS NULL OR label IS NULL)) AS n_kept FROM fv_out""", fx=["fx_completions"])
def q_yield_report(spark, sf):
    p = ps.parse_fv(_comp(spark, sf), "completion", "p").select("p.*")
    return ps.yield_report(p, "claim", "label")
