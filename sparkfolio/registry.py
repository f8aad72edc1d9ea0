"""Names of the registered queries and their DuckDB twins."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under a name, with its DuckDB SQL if there is one."""

    def add(run):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def _load() -> None:
    from importlib import import_module

    for module in ("text", "tables", "pages", "retrieval", "answers", "evaluation", "state"):
        import_module(f"sparkfolio.plans.{module}_queries")


_load()
