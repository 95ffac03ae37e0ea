"""Readers for provider catalogues, feeds, sitemaps, envelopes, batches and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marquee import schemas as S

SOURCE_ID = r"^[a-z0-9][a-z0-9-]{0,63}$"


PROVIDER_FIELDS = ["UID", "version", "title", "category", "startDate", "endDate", "showUnit", "descriptionFilterHtml", "sourceWebPromote"]


class SourceError(ValueError):
    """A source whose input cannot be used; ``code`` is a fixed, publishable reason."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def read_provider(spark: SparkSession, path: str) -> DataFrame:
    """src_01: provider catalogue, one JSON object a line; both spellings of the show list and the price are read.

    Column names are case-insensitive, so each spelling is parsed on its own from the row's text.
    """
    lines = spark.read.text(path)
    one = lambda shows, price: F.from_json("value", S.PROVIDER_ROW.replace("showInfo array", f"{shows} array").replace(" price:", f" {price}:"))
    parts = lines.select(one("showInfo", "price").alias("a"), one("showinfo", "price").alias("b"), one("showInfo", "Price").alias("c"), one("showinfo", "Price").alias("d"))
    shows = F.coalesce("a.showInfo", "b.showinfo")
    prices = F.coalesce("c.showInfo", "d.showinfo")
    both = F.zip_with(shows, prices, lambda x, y: x.withField("price", F.coalesce(x["price"], y["Price"])))
    return parts.select(*[F.col(f"a.{n}").alias(n) for n in PROVIDER_FIELDS], both.alias("shows"))


def unify_spellings(raw: DataFrame) -> DataFrame:
    shows = F.coalesce(F.col("showInfo"), F.col("showinfo")) if _has_both(raw) else F.col("showInfo")
    return raw.withColumn("shows", shows).drop("showInfo")


def _has_both(df: DataFrame) -> bool:
    return {"showInfo", "showinfo"} <= set(df.columns)


def require_rows(df: DataFrame, code: str = "EMPTY_INPUT") -> DataFrame:
    """grd_01: fail on an empty input. Reads at most one row."""
    if df.isEmpty():
        raise SourceError(code)
    return df


def require_category(df: DataFrame, category: Column, code: str) -> DataFrame:
    """src_02: fail when the expected category never occurs."""
    if df.where(category == code).isEmpty():
        raise SourceError("UNEXPECTED_CATEGORY")
    return df


def read_snapshot(spark: SparkSession, root: str, kind: str | None = None, source_id: str | None = None, schema: str | None = None) -> DataFrame:
    """src_03: partitioned snapshot; kind and source are pruned at planning time.

    With a ``schema`` of the data columns an empty snapshot gives no rows instead of an error.
    """
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, kind string, source_id string")
    df = reader.parquet(root)
    if kind is not None:
        df = df.where(F.col("kind") == kind)
    return df if source_id is None else df.where(F.col("source_id") == source_id)


def registry_problems(registry: DataFrame, id_col: str = "id") -> DataFrame:
    """src_04: ids that break the pattern or occur more than once."""
    c = F.col(id_col).cast("string")
    return (
        registry.groupBy(c.alias("id"))
        .agg(F.count("*").alias("n"))
        .select(
            "id",
            "n",
            F.when(~F.col("id").rlike(SOURCE_ID), F.lit("bad_pattern"))
            .when(F.col("n") > 1, F.lit("duplicate"))
            .alias("problem"),
        )
        .where(F.col("problem").isNotNull())
    )


def read_sitemap(spark: SparkSession, path: str, keep: str) -> DataFrame:
    """src_05: distinct URLs of a sitemap that match the pattern."""
    # One record per document, of which a file may hold several; a sitemap lists 50,000 URLs at most.
    docs = spark.read.text(path, lineSep="</urlset>").where(F.col("value").contains("<urlset"))
    nodes = docs.select(F.from_xml(F.concat(F.trim("value"), F.lit("</urlset>")), "url array<struct<loc: string>>").alias("x"))
    return listed_urls(nodes.select(F.explode("x.url").alias("u")), F.col("u.loc"), keep)


def listed_urls(df: DataFrame, loc: Column, keep: str) -> DataFrame:
    return df.select(F.trim(loc).alias("url")).where(F.col("url").rlike(keep)).distinct()


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """src_06: entries of JSON feeds, one feed object a line."""
    feed = spark.read.schema(S.FEED).json(path)
    return feed.select(F.explode("entry").alias("e")).select("e.*")


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """src_07: reviewed envelopes, one JSON object a line."""
    return spark.read.schema(S.ENVELOPE).json(path)


def explode_envelope(envelopes: DataFrame) -> DataFrame:
    """src_07: reviewed envelopes to one row per item, positions kept."""
    pages = envelopes.select(
        "sourceId", "kind", "reviewedAt", "traversal", F.posexplode("pages").alias("page_pos", "page")
    )
    return pages.select(
        "sourceId",
        "kind",
        "reviewedAt",
        "traversal",
        "page_pos",
        F.col("page.id").alias("page_id"),
        F.col("page.url").alias("page_url"),
        F.posexplode_outer("page.items").alias("item_pos", "item"),
    )


def batch_totals(events: DataFrame, sessions: Column) -> DataFrame:
    """src_08: recomputed control totals of a batch."""
    return events.agg(F.count("*").alias("events"), F.coalesce(F.sum(sessions), F.lit(0)).cast("bigint").alias("sessions"))


def read_or_empty(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """src_09: a JSON dimension, or no rows when the path does not exist."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.read.schema(schema).json(path, multiLine=multi_line)
    return spark.createDataFrame([], schema)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """src_10: page corpus (url, html)."""
    return spark.read.parquet(path)
