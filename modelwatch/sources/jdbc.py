"""Options of a JDBC scan."""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import unquote, urlsplit


def connection_options(settings: Mapping[str, str]) -> dict[str, str]:
    """Options for the jdbc format: a full URL if given, else user, password and database parts."""
    url = settings.get("DATABASE_URL")
    if not url:
        user, password, name = (settings.get(k) for k in ("DB_USER", "DB_PASSWORD", "DB_NAME"))
        if not name:
            raise ValueError("either DATABASE_URL or DB_NAME must be set")
        options = {"url": f"jdbc:postgresql://localhost:5432/{name}", "driver": "org.postgresql.Driver"}
        return {**options, **({"user": user} if user else {}), **({"password": password} if password else {})}
    parts = urlsplit(url)
    scheme = parts.scheme.split("+")[0]
    port = f":{parts.port}" if parts.port else ""
    options = {"url": f"jdbc:{scheme}://{parts.hostname}{port}{parts.path}"}
    if scheme == "postgresql":
        options["driver"] = "org.postgresql.Driver"
    if parts.username:
        options["user"] = unquote(parts.username)
    if parts.password:
        options["password"] = unquote(parts.password)
    return options
