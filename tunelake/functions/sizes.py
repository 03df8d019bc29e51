"""Sizes and error kinds."""

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ["B", "KB", "MB", "GB", "TB"]
GIB = 1024**3
MIB = 1024**2


def _fixed(n: Column, digits: int, unit: str) -> Column:
    """Fixed number of decimals; a tie goes to the even digit."""
    return F.format_string(f"%.{digits}f {unit}", F.bround(n, digits))


def size_text(n: Column) -> Column:
    """One decimal, B to PB; NULL gives `?`."""
    expr = F.when(n.isNull(), F.lit("?"))
    for power, unit in enumerate(UNITS):
        expr = expr.when(n < float(1024 ** (power + 1)), _fixed(n / float(1024**power), 1, unit))
    return expr.otherwise(_fixed(n / float(1024 ** len(UNITS)), 1, "PB"))


def short_size_text(n: Column) -> Column:
    """GB with two decimals, MB with one, else plain bytes."""
    return (
        F.when(n >= GIB, _fixed(n / float(GIB), 2, "GB"))
        .when(n >= MIB, _fixed(n / float(MIB), 1, "MB"))
        .otherwise(F.format_string("%d B", n))
    )


def error_kind(exception: Column, status: Column, message: Column) -> Column:
    """What went wrong in a download: auth, not_found, network, disk or unknown."""
    text = F.lower(message)
    os_errors = ["OSError", "IOError", "HTTPError", "PermissionError", "FileNotFoundError"]
    return (
        F.when(exception == "GatedRepoError", "auth")
        .when(exception == "RepositoryNotFoundError", "not_found")
        .when(status.isin(401, 403), "auth")
        .when(status == 404, "not_found")
        .when(
            exception.isin(
                "ConnectionError", "Timeout", "ConnectTimeout", "ReadTimeout",
                "ProxyError", "SSLError",
            ),
            "network",
        )
        .when(exception.isin(*os_errors) & (text.contains("disk") | text.contains("space")), "disk")
        .otherwise("unknown")
    )
