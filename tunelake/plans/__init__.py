"""Inputs derived from the driver tables, and the named queries over them."""

from importlib import import_module

MODULES = [
    "dataset_queries",
    "model_queries",
    "log_queries",
    "chat_queries",
    "run_queries",
    "usage_queries",
    "live_queries",
]


def load_all() -> None:
    """Import the query modules, which registers their queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
