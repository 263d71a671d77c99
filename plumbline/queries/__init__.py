"""Named queries over the test tables."""

from importlib import import_module

MODULES = ("profile", "quality", "relations", "evaluation", "catalog", "neighbors", "modelling", "reports", "edges")


def load_all() -> None:
    for name in MODULES:
        import_module(f"plumbline.queries.{name}")
