"""The registered queries of the event engine."""

from __future__ import annotations


def queries() -> dict:
    from . import assessment_ops, cluster_ops, composite_ops, evaluation_ops, gate_ops, landed_ops, market, metric_ops, model_ops, news_ops, registry, research_ops, signal_ops, source_ops, split_ops, stateful_ops, text_ops  # noqa: F401

    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    from . import registry

    return registry.ORACLE
