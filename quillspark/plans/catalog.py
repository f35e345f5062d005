"""All registered queries of the core library, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators import assembly, briefs, bundles, chapters, decisions, documents, figures, layout, lifecycle, packets, progress, recovery, repairs, review, rules, sketches, structure, termbase, texts, wholes
from quillspark.sinks import assets, exports, migrate, patches, sidecars
from quillspark.sources import web
from quillspark.streaming import activity, leases

MODULES = (review, documents, packets, progress, structure, rules, texts, decisions, layout, bundles, briefs, chapters, figures, assembly, recovery, wholes, sketches, termbase, lifecycle, repairs, web, assets, exports, migrate, patches, sidecars, activity, leases)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
