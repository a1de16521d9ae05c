"""JDBC addresses and drivers by database type."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

# URL form and driver class of each supported database.
URL_FORMS = {
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mssql": "jdbc:sqlserver://{host}:{port};databaseName={database}",
}
DRIVERS = {
    "mysql": "com.mysql.cj.jdbc.Driver",
    "postgresql": "org.postgresql.Driver",
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
}
DEFAULT_DB_TYPE = "mysql"


def db_type_of(config: Mapping[str, Any], default: str = DEFAULT_DB_TYPE) -> str:
    name = str(config.get("db_type") or default).lower()
    if name not in URL_FORMS:
        raise ValueError(f"db_type {name!r} is not one of {sorted(URL_FORMS)}")
    return name


def database_of(config: Mapping[str, Any]) -> Any:
    return config.get("database") or config.get("db")


def check_connection(config: Mapping[str, Any], what: str) -> None:
    """Either an explicit ``url`` and ``driver``, or the parts a dialect needs."""
    if config.get("url"):
        if not config.get("driver"):
            raise ValueError(f"{what}: 'url' needs 'driver' next to it")
        return
    absent = [k for k in ("host", "port", "user", "password") if config.get(k) is None]
    if not database_of(config):
        absent.append("database")
    if absent:
        raise ValueError(f"{what} lacks {', '.join(absent)}")
    db_type_of(config)


def connection_options(config: Mapping[str, Any]) -> dict[str, str]:
    """``url``, ``driver`` and credentials as Spark's JDBC options."""
    if config.get("url"):
        out = {"url": config["url"], "driver": config["driver"]}
    else:
        db_type = db_type_of(config)
        out = {
            "url": URL_FORMS[db_type].format(
                host=config["host"], port=config["port"], database=database_of(config)),
            "driver": DRIVERS[db_type],
        }
    for key in ("user", "password"):
        if config.get(key) is not None:
            out[key] = str(config[key])
    return out
