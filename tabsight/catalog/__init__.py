"""Named queries over the driver tables, one module per operator family."""

from importlib import import_module

MODULES = (
    "ingest",
    "filters",
    "profiles",
    "dependencies",
    "charts",
    "hypothesis",
    "timeseries",
    "text",
    "findings",
    "sqlqueries",
    "streams",
    "mining",
    "models",
    "maintenance",
)


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
