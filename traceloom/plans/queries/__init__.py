"""The registered queries, one module per operator family."""

from importlib import import_module

FAMILIES = ("triage", "identity", "scalars", "links", "reading", "ingest", "sequences", "streams")


def register_all() -> None:
    for name in FAMILIES:
        import_module(f"{__name__}.{name}")
