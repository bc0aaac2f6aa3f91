"""URL columns: normal form, what is worth crawling, image addresses, srcset lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of addresses that do not lead to documents.
DENIED = (
    "/login", "/logout", "/signin", "/signout", "/register", "/admin", "/wp-admin", "/api/", "/cgi-bin/", ".xml", ".json", ".rss", ".atom",
    "javascript:", "mailto:", "tel:", "?page=", "?sort=", "?filter=",
)
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff")


def scheme_host(u: Column) -> Column:
    return F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def host(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def normalize(u: Column, keep_routes: bool = False) -> Column:
    """Without fragment (but ``#/...`` if routes are kept) and closing slashes; what is no address stays."""
    p = F.regexp_replace(path(u), "/+$", "")
    query = F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)
    out = F.concat(scheme_host(u), F.when(p == "", "/").otherwise(p), query)
    if keep_routes:
        out = F.concat(out, F.regexp_extract(u, r"(#/.*)$", 1))
    return F.when(scheme_host(u) == "", u).otherwise(out)


def hash_route(base: Column, route: Column) -> Column:
    return F.concat(F.substring_index(base, "#", 1), F.lit("#"), route)


def crawlable(u: Column) -> Column:
    low = F.lower(u)
    denied = low.rlike("|".join("\\Q" + d + "\\E" for d in DENIED))
    anchor = low.rlike(r"^[^#]*#[^/]")
    return ~(denied | anchor | low.rlike(r"/\d{4}/\d{2}/\d{2}/"))


def in_scope(u: Column, hosts: list[str], prefix: str) -> Column:
    return host(u).isin([h.lower() for h in hosts]) & path(u).startswith(prefix)


def resolve(base: Column, href: Column) -> Column:
    """An address as seen from a page: absolute, host-relative, fragment, or relative to the page's folder."""
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), "[^/]*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(scheme_host(base), href))
        .when(href.startswith("#"), F.concat(F.substring_index(base, "#", 1), href))
        .otherwise(F.concat(scheme_host(base), folder, href))
    )


def allowed_image(u: Column, prefixes: list[str]) -> Column:
    """The whole address ends like an image file, so a query string rules it out."""
    if not any(p.startswith("image/") for p in prefixes):
        return F.lit(False)
    return F.lower(u).rlike(r"^https?://.*\.(" + "|".join(IMAGE_ENDINGS) + ")$")


def is_svg(u: Column) -> Column:
    return F.lower(F.regexp_replace(u, r"[?#].*$", "")).rlike(r"\.svgz?$")


def srcset(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ","), lambda x: F.split(F.trim(x), " ")[0]), lambda x: x != "")
