"""Every registered query of the survey engine and its DuckDB SQL."""

from __future__ import annotations

from pelagia.plans import acoustic_queries, biology_queries, cleaning_queries, geo_queries, presentation_queries, registry, report_queries, source_queries, uncertainty_queries, validation_queries  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.SQL)
