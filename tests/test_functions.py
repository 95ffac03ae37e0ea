"""Text, date and URL expressions on literal cases."""

import datetime as dt
import hashlib
import html
import unicodedata

import pytest
from pyspark.sql import functions as F

from marquee.functions import dates as D, text as T, urls as U, values as V


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


def test_clean(spark):
    raw = " <b>A &amp;lt; B</b>　&nbsp;c&#39;s\n "
    assert one(spark, raw, T.clean) == "A &lt; B c's"
    assert one(spark, "Zo&euml; &#x42; &#8364; &ndash;", T.clean_exact) == "Zoë B € –"
    assert one(spark, None, T.clean) == ""


@pytest.mark.parametrize("text", ["演唱會 Live!", "Ａｂｃ　１２３", "Straße_台北", "ｶﾞ", ""])
def test_normalized_exact(spark, text):
    folded = unicodedata.normalize("NFKC", text).replace("台", "臺")
    want = "".join(c for c in folded if c.isalnum() or c == "_").casefold()
    assert one(spark, text, T.normalized_exact) == want


def test_title_key(spark):
    assert one(spark, "【03/08 花蓮場】 海風 夜曲", T.title_key) == "海風夜曲"
    assert one(spark, "[a bracket that is far too long to go] X", T.title_key).startswith("abracket")


def test_stable_id_counts_null_as_empty(spark):
    r = spark.sql("select 'u' a, cast(null as string) b, 'c' c").select(T.stable_id(F.col("a"), F.col("b"), F.col("c")).alias("r")).first()["r"]
    assert r == hashlib.sha256("u||c".encode()).hexdigest()[:20]


def test_region(spark):
    assert one(spark, "台北市士林區", T.region_of) == "臺北市"
    assert one(spark, "River", T.region_of) == V.REGION_UNKNOWN
    assert one(spark, "新北市淡水區", T.region_with_short) == "新北市"
    assert one(spark, "北市河岸路12號", T.region_with_short) == "臺北市"
    assert one(spark, "River Hall", T.region_with_short) is None


def test_prices(spark):
    df = spark.sql("select * from values (320, 1480), (750, 750), (null, 9) as t(lo, hi)")
    assert [r[0] for r in df.select(T.price_range(F.col("lo"), F.col("hi"))).collect()] == ["NT$320–1,480", "NT$750", None]
    df = spark.sql("select * from values ('<i>NT$ 90</i>', 'Y'), ('', 'N'), (null, 'Y') as t(p, s)")
    assert [r[0] for r in df.select(T.price_text(F.col("p"), F.col("s"))).collect()] == ["NT$ 90", V.PRICE_FREE, V.PRICE_UNKNOWN]
    once = one(spark, "免費", T.prior_price)
    assert one(spark, once, T.prior_price) == once


@pytest.mark.parametrize(
    "raw, want",
    [("2025/03/04 08:30:00", dt.date(2025, 3, 4)), ("2025-7-9", dt.date(2025, 7, 9)), ("2025-04-31", None), ("x", None), (None, None), ("20250304", None)],
)
def test_lenient_date(spark, raw, want):
    assert one(spark, raw, D.lenient_date) == want


def test_session(spark):
    got = one(spark, "2025/09/12T18:20:00", D.session)
    assert (got["date"], got["time"]) == (dt.date(2025, 9, 12), "18:20")
    assert one(spark, "2025/09/12", D.session)["time"] is None
    assert one(spark, "2025/09/12 24:30:00", D.session) is None


def test_utc_stamp(spark):
    df = spark.sql("select * from values ('2025-05-16', '09:15:00Z'), ('2025-05-18', '11:00:00'), ('2025-14-02', '11:00:00Z') as t(d, c)")
    assert [r[0] for r in df.select(D.utc_stamp(F.col("d"), F.col("c"))).collect()] == ["2025-05-16T09:15:00+00:00", None, None]


def test_local_time(spark):
    df = spark.sql("select timestamp_ntz '2026-10-25 20:00:00' t")
    r = df.select(D.local_day(F.col("t")).alias("d"), F.date_format(D.local_time(F.col("t")), "HH:mm").alias("c"), D.cross_day(F.col("t")).alias("x")).first()
    assert (r["d"], r["c"], r["x"]) == (dt.date(2026, 10, 26), "04:00", 1)


@pytest.mark.parametrize(
    "url, safe, detail",
    [
        ("https://site.example/a", True, True), ("javascript:void(0)", False, False), ("https://who:knows@site.example/x", False, False),
        ("data:text/plain,yo", False, False), ("https://tixcraft.com/", True, False), ("http://a.example/b", True, False), (None, False, False),
    ],
)
def test_safe_urls(spark, url, safe, detail):
    assert one(spark, url, U.is_safe) is safe
    assert bool(one(spark, url, U.is_detail)) is detail


def test_platform_and_source(spark):
    assert one(spark, "https://Deck.KKTIX.cc/events/q", U.platform_of) == "KKTIX"
    assert one(spark, "https://ticket.ibon.com.tw/y", U.platform_of) == "ibon"
    assert one(spark, "https://evil.example/x", U.platform_of) is None
    assert one(spark, "https://comedyclub.kktix.cc/e", U.source_of) == "comedyclub"
    assert one(spark, "https://other.kktix.cc/e", U.source_of) == "kktix"


def test_canonical_url(spark):
    a = one(spark, "https://park.example/展覽/山 ", U.canonical)
    assert a == one(spark, "https://park.example/%E5%B1%95%E8%A6%BD/%E5%B1%B1%20", U.canonical)
    assert one(spark, "https://a.example/x+y~z*?q=1#f", U.canonical) == "https://a.example/x%2By~z%2A?q=1#f"


def test_range_and_bounds(spark):
    from marquee.operators import extract as X

    def sessions(text):
        s = one(spark, text, lambda c: D.sessions_from_points(X.dotted_points(c)))
        return None if s is None else [(str(x["date"]), x["time"]) for x in s]

    assert sessions("2025.02.08 18:00 (六) - 2025.02.08 20:10 (六)") == [("2025-02-08", "18:00")]
    assert sessions("2025.02.14 20:00 (五) - 2025.02.15 15:30 (六)") == [("2025-02-14", "20:00"), ("2025-02-15", "15:30")]
    assert sessions("2025.03.01 (六)") == [("2025-03-01", None)]
    assert sessions("2025.06.06 (五) ~ 2025.07.20 (日)") is None

    def period(dates, open_ended=False):
        df = spark.createDataFrame([([dt.date.fromisoformat(d) for d in dates], open_ended)], "d array<date>, o boolean")
        p = df.select(D.period_from_dates(F.col("d"), F.col("o")).alias("p")).first()["p"]
        return tuple(str(x) if x else None for x in p)

    assert period([]) == (None, None, None)
    assert period(["2025-01-30"]) == ("2025-01-30", "2025-01-30", None)
    assert period(["2025-02-11"], True) == ("2025-02-11", None, None)
    assert period(["2025-08-03", "2025-07-02"])[2] == "reversed dates"
