"""URL parts; NULL where the part is absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import _extract


def url_scheme(x: Column) -> Column:
    return F.lower(_extract(x, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def url_domain(x: Column) -> Column:
    return F.lower(_extract(x, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^@/?#]*@)?([^:/?#]+)", 1))


def url_port(x: Column) -> Column:
    return _extract(x, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^@/?#]*@)?[^:/?#]+:([0-9]+)", 1)


def url_path(x: Column) -> Column:
    return _extract(x, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?+[^/?#]*/([^?#]+)", 1)


def url_parameters(x: Column) -> Column:
    return _extract(x, r"\?([^#]+)", 1)


def url_fragment(x: Column) -> Column:
    return _extract(x, r"#(.+)$", 1)


def url_param(x: Column, name: str) -> Column:
    return _extract(x, rf"[?&]\Q{name}\E=([^&#]*)", 1)


def url_suffix(x: Column) -> Column:
    """The last label of the host (no public suffix list is shipped; pass one to a join for more)."""
    return _extract(url_domain(x), r"\.([^.]+)$", 1)


url_tld = url_suffix


def url_subdomain(x: Column) -> Column:
    """Labels before the last two."""
    return _extract(url_domain(x), r"^(.+)\.[^.]+\.[^.]+$", 1)
