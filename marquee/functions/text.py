"""Text expressions.

All of them are built-in column expressions except ``clean_exact`` and ``nfkc``
(and what is built on them), which are Arrow batch UDFs because Spark SQL has
neither the full HTML entity table nor Unicode compatibility folding.

Letters and digits are matched with ``[\\p{L}\\p{N}_]``: Java's plain ``\\w`` is
ASCII only, and its ``(?U)`` form also takes combining marks.
"""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from marquee.functions import values as V

NON_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}\x{85}\x{0B}]+"
# The entities that appear in practice; the ampersand is last so that an escaped
# entity is unescaped once only.
NAMED_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else html.unescape(v))


@F.pandas_udf(StringType())
def _exact_word_key(values: pd.Series) -> pd.Series:
    def one(v):
        folded = unicodedata.normalize("NFKC", v or "").replace("台", "臺")
        return "".join(ch for ch in folded if ch == "_" or ch.isalnum()).casefold()

    return values.map(one)


def or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse(c: Column) -> Column:
    """Whitespace runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def unescape_named(c: Column) -> Column:
    return reduce(lambda acc, e: F.replace(acc, F.lit(e[0]), F.lit(e[1])), NAMED_ENTITIES, c)


def clean(c: Column) -> Column:
    """fn_01: strip tags, unescape entities, collapse whitespace."""
    return collapse(unescape_named(strip_tags(or_empty(c))))


def clean_exact(c: Column) -> Column:
    """fn_01 with the complete HTML entity table."""
    return collapse(_unescape(strip_tags(or_empty(c))))


def nfkc(c: Column) -> Column:
    return _nfkc(c)


def fold_tai(c: Column) -> Column:
    return F.replace(c, F.lit("台"), F.lit("臺"))


def casefold(c: Column) -> Column:
    """Lower case plus the two folds that matter in listing titles (sharp s, final sigma)."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def word_key(c: Column) -> Column:
    """fn_03: letters, digits and underscore only, case-folded."""
    return casefold(F.regexp_replace(or_empty(c), NON_WORD, ""))


def normalized(c: Column) -> Column:
    """fn_02 in built-in form (no compatibility folding)."""
    return word_key(fold_tai(or_empty(c)))


def normalized_exact(c: Column) -> Column:
    """fn_02 exactly, with NFKC and full case folding."""
    return _exact_word_key(c)


LISTING_PREFIX = r"^\s*[【\[][^】\]]{0,20}[】\]]\s*"


def without_listing_prefix(c: Column) -> Column:
    return F.regexp_replace(or_empty(c), LISTING_PREFIX, "")


def title_key(c: Column, exact: bool = False) -> Column:
    """fn_13: title without a short leading bracket, then the word key."""
    bare = without_listing_prefix(c)
    return normalized_exact(bare) if exact else normalized(bare)


def tidy(c: Column, exact: bool = False) -> Column:
    """fn_04: compatibility folding (exact form) and collapsed whitespace."""
    base = or_empty(c)
    return collapse(nfkc(base) if exact else base)


def place_key(c: Column) -> Column:
    """fn_04: place text without blanks, underscores, dots and brackets. Takes tidied text."""
    return fold_tai(F.regexp_replace(c, r"[\s\p{Z}_・·()（）]", ""))


def stable_id(*parts: Column, length: int = 20) -> Column:
    """fn_08: hex SHA-256 of the parts joined by a pipe. NULL counts as empty text."""
    joined = F.concat_ws("|", *[or_empty(p) for p in parts])
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, length)


def first_contained(c: Column, names: list[str], default: Column) -> Column:
    """First name of an ordered list contained in the text; list order decides, not position."""
    hits = [F.when(c.contains(name), F.lit(name)) for name in names]
    return F.coalesce(*hits, default)


def region_of(address: Column, default: str = V.REGION_UNKNOWN, cities: list[str] | None = None) -> Column:
    """fn_09: region named in an address."""
    return first_contained(fold_tai(or_empty(address)), cities or V.CITIES, F.lit(default))


def region_with_short(
    text: Column, cities: list[str] | None = None, short: dict[str, str] | None = None
) -> Column:
    """fn_10: full names first, then short names at the start of a token; NULL when neither."""
    folded = fold_tai(collapse(or_empty(text)))
    short_hits = [
        F.when(folded.rlike(r"(?:^|[\s\p{Z}/、])" + k), F.lit(v))
        for k, v in (short or V.SHORT_CITIES).items()
    ]
    return F.coalesce(first_contained(folded, cities or V.CITIES, F.lit(None)), *short_hits)


def park_of(venue: Column, address: Column) -> Column:
    """fn_15: park tag of a venue and address."""
    text = F.concat(or_empty(venue), or_empty(address))
    ladder = F.lit("")
    for tag, pattern in reversed(V.PARK_PATTERNS):
        ladder = F.when(text.rlike(pattern), F.lit(tag)).otherwise(ladder)
    return ladder


def cap(c: Column, n: int) -> Column:
    """srt_06: text truncated to n characters."""
    return F.substring(c, 1, n)


def price_text(price: Column, on_sales: Column) -> Column:
    """fn_16: cleaned price, else the free flag, else the default text."""
    given = cap(clean(price), 180)
    return (
        F.when(F.length(given) > 0, given)
        .when(on_sales == "N", F.lit(V.PRICE_FREE))
        .otherwise(F.lit(V.PRICE_UNKNOWN))
    )


def price_range(low: Column, high: Column) -> Column:
    """agg_17: one amount or a range; NULL unless both are present."""
    fmt = lambda c: F.format_number(c, 0)
    return F.when(
        low.isNotNull() & high.isNotNull(),
        F.when(low == high, F.concat(F.lit("NT$"), fmt(low))).otherwise(
            F.concat(F.lit("NT$"), fmt(low), F.lit("–"), fmt(high))
        ),
    )


def prior_price(price: Column) -> Column:
    """fn_16: an earlier price carries its prefix exactly once."""
    prefix = "票價未逐日確認；"
    return F.when(price.startswith(prefix), price).otherwise(F.concat(F.lit(prefix + "前次人工核對："), price))


def badge_price(badge: Column) -> Column:
    """fn_16: price text of a list badge."""
    return (
        F.when(badge == "free", F.lit("免費（仍請確認官方參加條件）"))
        .when(badge == "paid", F.lit("付費，詳細票價請查官方"))
        .otherwise(F.lit("官網未提供結構化票價，請查官方"))
    )


def join_notes(*parts: Column) -> Column:
    """fn_24: non-empty parts joined by the full-width semicolon."""
    return F.concat_ws("；", *[F.when(F.length(p) > 0, p) for p in parts])


def listing_summary(region: Column, venue: Column, address: Column) -> Column:
    """prj_03: generated sentence from basic facts; falls back to the address."""
    place = F.when(F.length(or_empty(venue)) > 0, venue).otherwise(or_empty(address))
    return F.concat(region, F.lit("的展覽，展出於"), place, F.lit("。實際開放日與入場規定請查閱來源。"))


def live_summary(region: Column, venue: Column, label: str) -> Column:
    return F.concat(region, F.lit(f"的{label}，演出地點為"), venue, F.lit("。"))


def quoted_title(c: Column) -> Column:
    """fn_22: title between the outer 《》 at the end of the text, else the text itself."""
    inner = F.regexp_extract(c, r"《(.*)》\s*$", 1)
    return F.when(c.rlike(r"《(.*)》\s*$"), collapse(inner)).otherwise(c)


def without_badge(c: Column) -> Column:
    """fn_22: title without its leading ticket badge."""
    return F.regexp_replace(c, r"^\[\s*(?:免票|售票)\s*\]\s*", "")


def badge_of(c: Column) -> Column:
    return (
        F.when(c.contains("[ 免票 ]"), F.lit("free"))
        .when(c.contains("[ 售票 ]"), F.lit("paid"))
        .otherwise(F.lit(""))
    )


def session_label(name: Column) -> Column:
    """fn_25: label of the part before ' - '; unknown names stay."""
    head = F.split_part(name, F.lit(" - "), F.lit(1))
    pairs = [F.lit(x) for kv in V.SESSION_LABELS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[head], name)


def lookup(key: Column, mapping: dict[str, str]) -> Column:
    """joi_17: dictionary lookup as a constant map; NULL when absent."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key]
