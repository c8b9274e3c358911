"""Address functions as column expressions (hosts, slugs, sites); nothing here needs Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts accepted by the source filter besides those that end in .br.
ALLOWED_HOSTS = ["brasil247.com", "exame.com", "g1.globo.com", "globo.com", "metropoles.com", "revistaoeste.com"]
# Parts of an address that mark a login page.
LOGIN_MARKERS = ["require_login", "/login", "signin", "credentials_cookie_auth", "acl_users"]


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space at both ends, no-break spaces too."""
    return F.regexp_replace(text, r"(?U)^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")


def host(url: Column) -> Column:
    """Lower-case host name without user info, port and outer dots; '' where there is none, null for null."""
    return F.trim(F.lower(F.regexp_extract(strip(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]*)", 1)), F.lit("."))


def site(url: Column) -> Column:
    """The host without one leading ``www.`` or ``m.``."""
    return F.regexp_replace(host(url), r"^(?:www|m)\.", "")


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def slug_title(url: Column) -> Column:
    """The last path segment split at hyphens, without its last token, joined by spaces."""
    tokens = F.split(last_segment(url), "-")
    return F.array_join(F.slice(tokens, F.lit(1), F.size(tokens) - 1), " ")


def is_login_url(url: Column) -> Column:
    found = F.lit(False)
    lowered = F.lower(F.coalesce(url, F.lit("")))
    for marker in LOGIN_MARKERS:
        found = found | F.contains(lowered, F.lit(marker))
    return found


def fetch_candidates(url: Column) -> Column:
    """The address, then its https form when it is plain http; each once."""
    secure = F.concat(F.lit("https://"), F.substring(url, F.lit(8), F.length(url)))
    return F.array_distinct(F.when(F.startswith(url, F.lit("http://")), F.array(url, secure)).otherwise(F.array(url)))


def allowed_source(url: Column, hosts: list[str] | None = None, suffix: str = ".br") -> Column:
    """Whether the host ends in ``suffix`` or is exactly one of ``hosts``; null and hostless count as false."""
    h = host(url)
    return F.coalesce(F.endswith(h, F.lit(suffix)) | h.isin(ALLOWED_HOSTS if hosts is None else hosts), F.lit(False))
