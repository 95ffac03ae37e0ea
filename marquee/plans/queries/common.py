"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import values as V
from marquee.plans.registry import query
from marquee.sources import bindings as B
from marquee.sources.bindings import table



def as_of():
    return F.lit(B.AS_OF).cast("date")


def events_as_of():
    return F.lit(B.EVENTS_AS_OF).cast("date")


AS_OF_SQL = f"DATE '{B.AS_OF}'"
EVENTS_AS_OF_SQL = f"DATE '{B.EVENTS_AS_OF}'"

SESSION = f"WITH {B.SESSION_SQL}"
LISTING = f"WITH {B.LISTING_SQL}"
PERIOD = f"WITH {B.PERIOD_SQL}"
SNAP = f"WITH {B.SNAP_SQL}"
LIVE = f"WITH {B.LIVE_SQL}".replace("'unverified'", "'" + V.UNVERIFIED_PLATFORM + "'")

# Text helpers of the SQL twins.
SPACE_SQL = r"[\s\p{Z}\x{85}\x{0B}]+"


def word_key_sql(expr: str) -> str:
    return rf"replace(replace(lower(regexp_replace({expr}, '[^\p{{L}}\p{{N}}_]', '', 'g')), 'ß', 'ss'), 'ς', 'σ')"


def collapse_sql(expr: str) -> str:
    return rf"trim(regexp_replace({expr}, '{SPACE_SQL}', ' ', 'g'))"


def clean_sql(expr: str) -> str:
    tags = f"regexp_replace({expr}, '<[^>]*>', '', 'g')"
    return collapse_sql(unescape_sql(tags))


def unescape_sql(expr: str) -> str:
    out = expr
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


URL_RE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_sql(expr: str, group: int) -> str:
    return f"regexp_extract({expr}, '{URL_RE}', {group})"


def host_sql(expr: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({url_sql(expr, 2)}, '^.*@', ''), ':\d*$', ''))"


__all__ = [n for n in dir() if not n.startswith("_")]
