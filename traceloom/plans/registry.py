"""Registered queries: a Spark callable each, and the SQL that must agree with it."""

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


def load() -> None:
    from .queries import register_all
    register_all()
