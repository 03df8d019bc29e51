"""Registry of named queries and their oracle SQL."""

QUERIES = {}
ORACLES = {}


def named(name: str, oracle: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame, with DuckDB SQL for the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add
