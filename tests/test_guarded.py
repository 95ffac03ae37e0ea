"""Guards gathered in the writing pass, numbered commits and order-free digests."""

from pyspark.sql import functions as F

from marquee.operators import quality as Q
from marquee.sources import sinks


def publish(spark, root, version, rows, after):
    df = spark.createDataFrame([(i,) for i in rows], "id bigint")
    guard = sinks.Guarded(df, {"empty": F.count("*") == 0, "negative": F.bool_or(F.col("id") < 0)})
    return sinks.publish_guarded(guard.rows.where("id <> 5"), guard, root, version, after)


def test_publish_refuse_and_conflict(spark, tmp_path):
    root = str(tmp_path / "p")
    read = lambda: sorted(r["id"] for r in sinks.read_committed(spark, root, "id bigint").collect())
    assert read() == [] and publish(spark, root, "none", [], 0) == "empty" and read() == []
    assert publish(spark, root, "a", [1, 5], 0) == "published" and read() == [1]
    assert publish(spark, root, "b", [1, -1], 1) == "negative" and read() == [1]
    # Two publishers build on the same commit: the second one loses and leaves nothing behind.
    assert publish(spark, root, "c", [2], 1) == "published" and publish(spark, root, "d", [3], 1) == "conflict"
    assert read() == [2] and sinks.commits(spark, root) == [(1, "a"), (2, "c")]
    assert sorted(p.name for p in (tmp_path / "p").iterdir() if p.name.startswith("v=")) == ["v=a", "v=c"]
    assert sinks.expire(spark, root, 1) == ["a"] and read() == [2]


def test_digest_and_totals(spark):
    def totals(rows):
        return spark.createDataFrame(rows, "g int, a string, b string").groupBy("g").agg(F.count("*").alias("n"), Q.multiset_digest(F.col("a"), F.col("b")).alias("d"))

    one = [(1, "x", "y"), (1, "x", "y"), (2, "ab", "c"), (3, None, "q"), (4, "z", "z"), (6, "r", "r")]
    two = [(1, "x", "y"), (1, "x", "y"), (2, "a", "bc"), (3, "", "q"), (5, "z", "z"), (6, "r", "r")]
    got = {r["g"]: r["agrees"] for r in Q.compared_totals(totals(one), totals(two[::-1]), ["g"], ["n", "d"]).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}
