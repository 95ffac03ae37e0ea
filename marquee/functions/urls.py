"""URL expressions.

URLs are split with one regular expression instead of ``parse_url``: listing URLs hold raw
non-ASCII characters and blanks, which the strict parser turns into NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marquee.functions import values as V

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    return _part(url, 2)


def host(url: Column) -> Column:
    """Lower-case host without user information and port."""
    bare = F.regexp_replace(authority(url), r"^.*@", "")
    return F.lower(F.regexp_replace(bare, r":\d*$", ""))


def user_info(url: Column) -> Column:
    return F.regexp_extract(authority(url), r"^(.*)@", 1)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def is_safe(url: Column, schemes: tuple[str, ...] = ("https", "http")) -> Column:
    """flt_11: allowed scheme, host present, no credentials."""
    return F.coalesce(
        scheme(url).isin(*schemes) & (F.length(host(url)) > 0) & user_info(url).isin("", ":"), F.lit(False)
    )


def is_detail(url: Column) -> Column:
    """flt_11: a safe https URL that is not a home page."""
    return is_safe(url, ("https",)) & ~path(url).isin("", "/")


def safe_or_empty(url: Column, schemes: tuple[str, ...] = ("https", "http")) -> Column:
    return F.when(is_safe(url, schemes), url).otherwise(F.lit(""))


def is_listed_page(url: Column, base_host: Column, prefix: str) -> Column:
    """flt_10: https on the source's own host, under its prefix, no query, fragment or credentials."""
    return F.coalesce(
        (scheme(url) == "https")
        & (host(url) == base_host)
        & (query(url) == "")
        & (fragment(url) == "")
        & path(url).startswith(prefix)
        & user_info(url).isin("", ":"),
        F.lit(False),
    )


def label_by_host(host_col: Column, exact: dict[str, str], suffixes: dict[str, str]) -> Column:
    """Exact host map first, then suffix rules; NULL when unmapped."""
    found = [F.create_map(*[F.lit(x) for kv in exact.items() for x in kv])[host_col]]
    found += [F.when(host_col.endswith(s), F.lit(label)) for s, label in suffixes.items()]
    return F.coalesce(*found)


def platform_of(url: Column, hosts: dict[str, str] | None = None, suffixes: dict[str, str] | None = None) -> Column:
    """fn_11: ticket platform of a URL."""
    return label_by_host(
        host(url),
        V.PLATFORM_HOSTS if hosts is None else hosts,
        V.PLATFORM_SUFFIXES if suffixes is None else suffixes,
    )


def source_of(url: Column, hosts: dict[str, str] | None = None, suffixes: dict[str, str] | None = None) -> Column:
    """fn_23: source id of a URL; NULL marks a row that must be rejected."""
    return label_by_host(
        host(url),
        V.SOURCE_HOSTS if hosts is None else hosts,
        V.SOURCE_SUFFIXES if suffixes is None else suffixes,
    )


def encode_path(p: Column) -> Column:
    """fn_12: percent-decode, then encode again with '/' kept.

    ``url_encode`` writes form encoding, so blanks, tilde, star and slash are corrected.
    """
    plus_kept = F.replace(p, F.lit("+"), F.lit("%2B"))
    encoded = F.url_encode(F.coalesce(F.try_url_decode(plus_kept), p))
    for have, want in (("+", "%20"), ("%7E", "~"), ("*", "%2A"), ("%2F", "/")):
        encoded = F.replace(encoded, F.lit(have), F.lit(want))
    return encoded


def canonical(url: Column) -> Column:
    """fn_12: one spelling for Unicode and percent-encoded paths."""
    tail = F.concat(
        F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(F.lit("")),
        F.when(fragment(url) != "", F.concat(F.lit("#"), fragment(url))).otherwise(F.lit("")),
    )
    return F.when(
        url.rlike(URL), F.concat(scheme(url), F.lit("://"), authority(url), encode_path(path(url)), tail)
    ).otherwise(url)


def without_dots(p: Column) -> Column:
    """Path with ``.`` and ``..`` segments resolved; none climbs above the root."""
    last = F.element_at(F.split(p, "/"), -1)
    folded = F.aggregate(
        F.split(p, "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.lit(1), F.size(acc) - 1))).when(s == ".", acc).otherwise(F.array_append(acc, s)),
    )
    return F.concat(F.array_join(folded, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))


def absolute(base: Column, href: Column) -> Column:
    """The link on its page: absolute links unchanged, all relative forms resolved, dot segments removed."""
    site = F.concat(scheme(base), F.lit("://"), authority(base))
    here = F.when(path(base) == "", F.lit("/")).otherwise(path(base))
    asked = F.when(query(base) != "", F.concat(F.lit("?"), query(base))).otherwise(F.lit(""))
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    own = F.regexp_extract(href, r"^([^?#]*)", 1)
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_replace(here, "[^/]*$", ""), own))
    resolved = F.when(joined.contains("/."), without_dots(joined)).otherwise(joined)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href == "", F.concat(site, path(base), asked))
        .when(href.startswith("#"), F.concat(site, path(base), asked, href))
        .when(href.startswith("?"), F.concat(site, here, href))
        .otherwise(F.concat(site, resolved, tail))
    )
