"""Queries of the training-data problems of this subpackage."""

from __future__ import annotations

from ..session import table
from . import authorship, doc_pairs, leakage, mixing, sentences, syntax


def p2_found(spark, sf_dir):
    return authorship.not_hand_written(table(spark, sf_dir, "parse_inputs"))


def p3_found(spark, sf_dir):
    return doc_pairs.found(table(spark, sf_dir, "parse_inputs"), table(spark, sf_dir, "atoms"))


def p4_found(spark, sf_dir):
    return syntax.failures(table(spark, sf_dir, "parse_inputs"))


def p4_rates(spark, sf_dir):
    return syntax.failure_rates(table(spark, sf_dir, "parse_inputs"))


def p3_pairs(spark, sf_dir):
    return doc_pairs.pairs(table(spark, sf_dir, "parse_inputs"), table(spark, sf_dir, "atoms"))


def p6_found(spark, sf_dir):
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def _mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_allocation(spark, sf_dir):
    return _mix(spark, sf_dir).allocation


def p7_shares(spark, sf_dir):
    return mixing.shares(_mix(spark, sf_dir))


def p8_found(spark, sf_dir):
    return sentences.units(table(spark, sf_dir, "documents"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_pairs": p3_pairs, "p4_found": p4_found, "p4_rates": p4_rates, "p6_found": p6_found, "p7_allocation": p7_allocation, "p7_shares": p7_shares,
    "p8_found": p8_found}
SQL: dict[str, str] = {}
