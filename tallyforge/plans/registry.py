"""Registered queries of the core library and their SQL oracles."""

from __future__ import annotations

from tallyforge.plans import _register, functions_plans, linkage_plans, pages_plans, pairing_plans, parsing_plans, quality_plans, reconcile_plans, review_plans, sources_plans  # noqa: F401


def flagship(spark, sf_dir):
    return _register.QUERIES["a4_reconcile_documents"](spark, sf_dir)


def queries():
    return dict(_register.QUERIES)


def oracle_sql():
    return dict(_register.SQL)
