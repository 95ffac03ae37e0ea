"""Cross-source reconciliation (joi_07, joi_08): the ordered greedy merge as Spark jobs.

Sequential meaning: records are read in priority order; each joins the first existing cluster
(in creation order) that it matches, or opens a new one. Region, venue, title and program of a
cluster are its first member's; sessions, ticket URLs and references grow, also by members from
other venues. A record's URLs are its tickets and its own page; a cluster's are all its tickets and
its first member's page. A record matches when the regions agree and either
  (a) the venues agree and it shares a (source, uid) reference, the program, or - at a known venue -
      a session together with an equal title, a shared URL or a title containing the other, or
  (b) the venues differ, the titles agree and a session with a clock is shared.

Distributed form:
  1. URLs and references that only one record holds can never match and are dropped; records that then
     look alike form one *signature*, so a hot group of copies is one row from here on.
  2. A match is an equality of keys: a reference, a program, or a title, URL or contained title together
     with a session. A signature asks for keys; a cluster gives those of its first member, and those that
     members bring, each from the order on in which the member joined.
  3. All signatures choose at once, given the clusters of the round before: the earliest cluster that
     gives a key they ask for before their own order. Choices of a cluster whose first member has itself
     moved are followed to the end by pointer doubling, and the next round starts. What holds for all
     orders below o in one round is decided rightly for o in the next, so the rounds end, and they end
     with the sequential result: a set of choices that repeats itself is the only one that does. After
     the second round only those choose anew who ask for a key whose givers changed.
  4. Later copies of a signature can fall to another cluster; the exact order of that copy is looked up.

No component, key or cluster is worked on by one task: rounds are joins and minima. Their number is the
depth to which one choice overturns another, not the length of a chain or the size of a component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.functions import text as T, values as V
from marquee.operators.ranking import checkpointed
from marquee.operators.steps import Steps
from marquee.operators.venues import program_identity, venue_identity

MIN_CONTAINED = 8
#: Titles of one gram that a task compares with the gram's look-ups.
TITLES_OF_A_CHUNK = 2000


def features(df: DataFrame, exact: bool = True) -> DataFrame:
    """Match features per record.

    Input: ord (total order), source, uid, title, region, venue, program (or NULL),
    sessions array<struct<date,time>>, urls array<string> (tickets), page (own page or NULL).
    """
    norm = T.normalized_exact if exact else T.normalized
    return df.select(
        "ord",
        norm(F.col("region")).alias("region_key"),
        venue_identity(F.col("venue"), exact).alias("venue_key"),
        (~norm(F.col("venue")).isin(*[v.replace("台", "臺") for v in V.VENUE_PLACEHOLDERS])).alias("venue_known"),
        T.title_key(F.col("title"), exact).alias("title_key"),
        program_identity(F.col("title"), F.col("program")).alias("program"),
        F.when(F.length(F.col("uid").cast("string")) > 0, F.concat_ws("|", F.col("source"), F.col("uid").cast("string"))).alias("ref"),
        F.array_sort(F.array_distinct(F.transform("sessions", lambda s: F.concat_ws(" ", s["date"].cast("string"), F.coalesce(s["time"], F.lit("")))))).alias("sessions"),
        F.array_distinct(F.filter(F.col("urls"), lambda u: (F.length(u) > 0))).alias("urls"),
        F.when(F.length("page") > 0, F.col("page")).alias("page"),
    )


def _shared(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Values of a column held by more than one record within the keys."""
    return df.groupBy(*keys, column).agg(F.min("ord").alias("_a"), F.max("ord").alias("_b")).where("_a < _b").select(*keys, column)


def signatures(feat: DataFrame, keep=checkpointed) -> tuple[DataFrame, DataFrame]:
    """(record -> signature, signature rows). Step 1."""
    place = ["region_key"]
    cited = F.array_union("urls", F.when(F.col("page").isNotNull(), F.array("page")).otherwise(F.array().cast("array<string>")))
    urls = feat.select("ord", *place, F.explode(cited).alias("url"))
    kept_urls = urls.join(_shared(urls, "url", place), [*place, "url"]).groupBy("ord").agg(
        F.array_sort(F.collect_set("url")).alias("_kept")
    )
    refs = feat.where("ref IS NOT NULL").select("ord", *place, "ref")
    kept_refs = refs.join(_shared(refs, "ref", place), [*place, "ref"]).select("ord", "ref")
    kept = F.coalesce("_kept", F.array().cast("array<string>"))
    slim = (
        feat.drop("ref")
        .join(kept_urls, "ord", "left")
        .join(kept_refs, "ord", "left")
        .withColumn("urls", F.array_sort(F.array_intersect("urls", kept)))
        .withColumn("page", F.when(F.array_contains(kept, F.col("page")), F.col("page")))
        .drop("_kept")
    )
    parts = ["region_key", "venue_key", "title_key", "program", "ref", "page"]
    text = F.concat_ws(
        "\x01",
        *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in parts],
        F.array_join("sessions", "\x02"), F.array_join("urls", "\x02"),
    )
    marked = keep(slim.withColumn("sig", F.unhex(F.sha2(text, 256))))
    cols = [*parts, "venue_known", "sessions", "urls"]
    sigs = marked.groupBy("sig").agg(
        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.first(F.struct(*cols)).alias("f")
    ).select("sig", "first_ord", "last_ord", "f.*")
    return marked.select("ord", "sig"), sigs


def contained_titles(sigs: DataFrame, chunk: int = TITLES_OF_A_CHUNK) -> DataFrame:
    """(region, venue, title, hub): each title with every distinct long title it contains.

    A title that contains another holds all of its grams of MIN_CONTAINED characters, so it is enough to
    look the shorter one up by the gram that the fewest titles of the venue hold; a gram held by its own
    title alone settles it without a look-up. The titles of a gram are cut into chunks of equal size, each
    met by all its look-ups, so a gram that many titles share makes many equal tasks.
    """
    place = ["region_key", "venue_key"]
    titles = sigs.where(F.col("venue_known") & (F.length("title_key") >= MIN_CONTAINED)).select(*place, "title_key").distinct()
    grams = F.transform(
        F.sequence(F.lit(1), F.length("title_key") - (MIN_CONTAINED - 1)),
        lambda i: F.substring(F.col("title_key"), i, F.lit(MIN_CONTAINED)),
    )
    held = titles.select(*place, "title_key", F.explode(F.array_distinct(grams)).alias("gram"))
    many = held.groupBy(*place, "gram").agg(F.count("*").alias("n"))
    rarest = held.join(many, [*place, "gram"]).groupBy(*place, F.col("title_key").alias("hub")).agg(F.min(F.struct("n", "gram")).alias("g"))
    asked = rarest.where("g.n > 1").select(*place, "hub", F.col("g.gram").alias("gram"), F.ceil(F.col("g.n") / chunk).cast("int").alias("chunks"))
    cuts = asked.select(*place, "gram", "chunks").distinct()
    long = held.join(cuts, [*place, "gram"]).withColumn("part", F.pmod(F.hash("title_key"), F.col("chunks")))
    short = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    found = long.join(short.drop("chunks"), [*place, "gram", "part"]).where(
        (F.col("title_key") != F.col("hub")) & F.col("title_key").contains(F.col("hub"))
    )
    return found.select(*place, "title_key", "hub")


def title_links(records: DataFrame) -> DataFrame:
    """(region, venue, title, other, how): titles of one venue that may stand for one event (joi_08).

    ``contained``: the title contains the other. ``url``: both cite one URL; the titles of a URL are
    linked to the least of them, so a URL of a whole venue gives a row for each title, not all pairs.
    ``records``: region_key, venue_key, venue_known, title_key, urls.
    """
    place = ["region_key", "venue_key"]
    inside = contained_titles(records).select(*place, F.col("title_key").alias("title"), F.col("hub").alias("other"), F.lit("contained").alias("how"))
    cited = records.where("venue_known").select(*place, "title_key", F.explode("urls").alias("url")).distinct()
    least = cited.groupBy(*place, "url").agg(F.min("title_key").alias("other"), F.max("title_key").alias("_top")).where("other < _top").drop("_top")
    by_url = cited.join(least, [*place, "url"]).where("title_key <> other").select(*place, F.col("title_key").alias("title"), "other", F.lit("url").alias("how")).distinct()
    return inside.unionByName(by_url)


def _key(kind: str, *parts) -> Column:
    return F.unhex(F.md5(F.concat_ws("\x01", F.lit(kind), *parts)))


def _each(items: Column, make) -> Column:
    return F.transform(items, make)


def _pairs(left: Column, right: Column, make) -> Column:
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: make(a, b))))


def _timed(sessions: Column) -> Column:
    return F.filter(sessions, lambda s: ~s.endswith(" "))


def nodes(sigs: DataFrame, keep=checkpointed) -> DataFrame:
    """Signatures named by their first order, with the titles that theirs contains (``hubs``)."""
    key = ["region_key", "venue_key", "title_key"]
    pairs = keep(contained_titles(sigs))
    hubs = pairs.groupBy(*key).agg(F.collect_set("hub").alias("hubs"))
    inside = pairs.select("region_key", "venue_key", F.col("hub").alias("title_key"), F.lit(True).alias("is_hub")).distinct()
    none = F.array().cast("array<string>")
    cited = F.array_distinct(F.concat("urls", F.when(F.col("page").isNotNull(), F.array("page")).otherwise(none)))
    merges = F.col("venue_known") | F.col("ref").isNotNull() | F.col("program").isNotNull()
    return sigs.join(hubs, key, "left").join(inside, key, "left").select(
        F.col("first_ord").alias("node"), "sig", "last_ord", "region_key", "venue_key", "venue_known", "title_key", "program", "ref", "sessions", "urls",
        cited.alias("cited"), F.coalesce("hubs", none).alias("hubs"), F.coalesce("is_hub", F.lit(False)).alias("is_hub"), merges.alias("merges"),
    )


def evidence(s: DataFrame) -> DataFrame:
    """(node, loose, venue, key, asks, gives, apart): what a signature looks for, and what it offers as a cluster's first.

    A key names one kind of match together with a session, where the match needs one; a record matches
    a cluster that gives a key which the record asks for. ``apart``: the venues must differ.
    """
    r, v, t, known = F.col("region_key"), F.col("venue_key"), F.col("title_key"), F.col("venue_known")
    empty = F.lit(None).cast("array<struct<key:binary,asks:boolean,gives:boolean,apart:boolean>>")
    row = lambda key, asks, gives, apart=False: F.struct(key.alias("key"), asks.alias("asks"), gives.alias("gives"), F.lit(apart).alias("apart"))
    yes, no = F.lit(True), F.lit(False)
    lists = [
        F.when(F.col("ref").isNotNull(), F.array(row(_key("r", r, v, F.col("ref")), yes, yes))),
        F.when(F.col("program").isNotNull(), F.array(row(_key("p", r, v, F.col("program")), yes, yes))),
        _each(F.col("sessions"), lambda x: row(_key("t", r, v, t, x), known, yes)),
        _each(_timed(F.col("sessions")), lambda x: row(_key("x", r, t, x), yes, yes, True)),
        # A title contains another: asked by the shorter, and by the longer for each that it contains.
        F.when(known & F.col("is_hub"), _each(F.col("sessions"), lambda x: row(_key("h", r, v, t, x), yes, no))),
        F.when(known, _pairs(F.col("hubs"), F.col("sessions"), lambda h, x: row(_key("t", r, v, h, x), yes, no))),
        _pairs(F.col("hubs"), F.col("sessions"), lambda h, x: row(_key("h", r, v, h, x), no, yes)),
    ]
    found = F.flatten(F.array_compact(F.array(*[F.coalesce(x, empty) for x in lists])))
    return s.select("node", "loose", F.col("venue_key").alias("venue"), F.explode(found).alias("e")).select("node", "loose", "venue", "e.*")


def _mixed(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Keys with several values of a column."""
    return rows.groupBy(*keys).agg(F.min(what).alias("_a"), F.max(what).alias("_b")).where("_a < _b").select(*keys)


def bridged_titles(s: DataFrame, cited: DataFrame) -> DataFrame:
    """(region, title) whose records may join a cluster of another title.

    The first of a title to do so shares a reference, program or URL with another title, or one of the
    titles contains the other.
    """
    key = ["region_key", "title_key"]
    found = [s.where("is_hub OR size(hubs) > 0").select(*key)]
    for rows, by in ((s.where("ref IS NOT NULL"), "ref"), (s.where("program IS NOT NULL"), "program"), (cited, "u")):
        found.append(rows.join(_mixed(rows, ["region_key", by], "title_key"), ["region_key", by], "left_semi").select(*key))
    return found[0].union(found[1]).union(found[2]).union(found[3]).distinct()


def telling_urls(s: DataFrame, cited: DataFrame, bridged: DataFrame) -> DataFrame:
    """Rows of ``cited`` whose URL is held by several signatures and by a title that crosses, with counts.

    A URL whose titles all stay with their own tells nothing that the title doesn't.
    """
    key = ["region_key", "u"]
    useful = cited.join(bridged, ["region_key", "title_key"], "left_semi").select(*key).distinct()
    many = cited.groupBy(*key).agg(F.count("*").alias("nu")).where("nu > 1").join(useful, key, "left_semi")
    return cited.where("venue_known").join(many, key)


def url_evidence(telling: DataFrame) -> DataFrame:
    """Evidence rows of URLs together with the own sessions of the record that cites them."""
    key = _key("u", F.col("region_key"), F.col("venue_key"), F.col("u"), F.col("x"))
    rows = telling.select("node", "loose", "region_key", "venue_key", "u", F.explode("sessions").alias("x"))
    return rows.select("node", "loose", F.col("venue_key").alias("venue"), key.alias("key"), F.lit(True).alias("asks"), F.lit(True).alias("gives"), F.lit(False).alias("apart"))


def url_sessions(s: DataFrame, telling: DataFrame) -> DataFrame:
    """(url key, session key, evidence key, by_url): pairs that records ask for, each once.

    ``by_url``: the URL has no more signatures than the session has, so clusters are looked up by it.
    """
    r, v = F.col("region_key"), F.col("venue_key")
    pairs = telling.select("region_key", "venue_key", "u", "nu", F.explode("sessions").alias("x")).distinct()
    many = s.select("region_key", F.explode("sessions").alias("x")).groupBy("region_key", "x").agg(F.count("*").alias("nx")).where("nx > 1")
    return pairs.join(many, ["region_key", "x"]).select(
        _key("U", r, v, F.col("u")).alias("uk"), _key("X", r, v, F.col("x")).alias("xk"), _key("u", r, v, F.col("u"), F.col("x")).alias("key"), (F.col("nu") <= F.col("nx")).alias("by_url")
    )


def loose_nodes(s: DataFrame, bridged: DataFrame) -> DataFrame:
    """Signatures that may ask for a key which no other one holds, but a cluster of unlike members gives."""
    title, ref = ["region_key", "title_key"], ["region_key", "ref"]
    titles = bridged.union(_mixed(s, title, "venue_key"))
    refs = _mixed(s.where("ref IS NOT NULL"), ref, "venue_key")
    return s.join(titles, title, "left_semi").select("node").union(s.join(refs, ref, "left_semi").select("node")).distinct()


def _open(keys: DataFrame) -> DataFrame:
    """Evidence that can matter, ``shared`` where several signatures hold the key.

    What members bring is asked for by holders of a shared key, or by records of titles that cross; keys of
    one signature are kept for these alone. The rows are dealt by key once, for the count and its join.
    """
    dealt = keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    common = dealt.groupBy("key").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).select("key", (F.col("_a") < F.col("_b")).alias("shared"))
    return dealt.join(common, "key").where("shared or (asks and loose)").drop("loose")


def _grown(moved: DataFrame, s: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, c, venue, t): what clusters give from order ``t`` on through members that joined them."""
    first = s.select(F.col("node").alias("c"), F.col("region_key").alias("r"), F.col("venue_key").alias("v"), F.col("title_key").alias("tt"), F.col("hubs").alias("hh"))
    own = moved.join(s.select("node", "sessions", "urls", "ref"), "node").join(first, "c")
    r, v, t = F.col("r"), F.col("v"), F.col("tt")
    ref = F.when(F.col("ref").isNotNull(), F.array(_key("r", r, v, F.col("ref")))).otherwise(F.array().cast("array<binary>"))
    keys = F.concat(
        ref, _each(F.col("sessions"), lambda x: _key("t", r, v, t, x)), _each(_timed(F.col("sessions")), lambda x: _key("x", r, t, x)),
        _pairs(F.col("hh"), F.col("sessions"), lambda h, x: _key("h", r, v, h, x)),
    )
    direct = own.select(F.explode(keys).alias("key"), "c", F.col("v").alias("venue"), F.col("at").alias("t"))
    # A URL of one member with a session of another; the first member's count from its own order.
    begin = moved.select("c").distinct().join(s.select(F.col("node").alias("c"), "sessions", F.col("cited").alias("urls")), "c").join(first, "c").withColumn("at", F.col("c"))
    both = own.select("c", "at", "r", "v", "sessions", "urls").unionByName(begin.select("c", "at", "r", "v", "sessions", "urls"))
    us = both.select("c", "at", "r", "v", F.explode("urls").alias("u")).groupBy(_key("U", r, v, F.col("u")).alias("uk"), "c", "v").agg(F.min("at").alias("tu"))
    xs = both.select("c", "at", "r", "v", F.explode("sessions").alias("x")).groupBy(_key("X", r, v, F.col("x")).alias("xk"), "c").agg(F.min("at").alias("tx"))
    by_url = pairs.where("by_url").join(us, "uk").join(xs, ["xk", "c"])
    by_session = pairs.where("not by_url").join(xs, "xk").join(us, ["uk", "c"])
    cols = ["key", "c", F.col("v").alias("venue"), F.greatest("tu", "tx").alias("t")]
    return direct.union(by_url.select(*cols)).union(by_session.select(*cols)).groupBy("key", "c", "venue").agg(F.min("t").alias("t"))


def _gone(moved: DataFrame) -> DataFrame:
    """First members that joined another cluster."""
    return moved.where("at = node").select("node")


def _unlike(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows that only one of two tables without repeated rows has."""
    both = new.select(*old.columns).union(old)
    return both.groupBy(*old.columns).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")


def _touched(other: DataFrame) -> DataFrame:
    """(c): clusters whose members or whose stay differ by the rows of ``other``."""
    return other.select("c").union(_gone(other)).distinct()


def _askers(other: DataFrame, keys: DataFrame, new: DataFrame, old: DataFrame, keep=checkpointed) -> DataFrame:
    """Records that ask for a key whose givers changed by the rows of ``other``.

    ``new`` and ``old`` are what the touched clusters give through members. A first member that moved, or
    came back, takes or returns what it gives alone.
    """
    turned = keep(_gone(other).groupBy("node").agg(F.count("*").alias("_n")).where("_n = 1").select("node"))
    given = keys.where("shared and gives").join(turned, "node", "left_semi").select("key")
    told = keep(_unlike(new, old).select("key").union(given).distinct())
    return keep(keys.where("asks").join(told, "key", "left_semi").select("node").distinct())


def _decided(gone: DataFrame, s: DataFrame, asks: DataFrame, gives: DataFrame, grown: DataFrame, records: DataFrame, keep=checkpointed) -> DataFrame:
    """(node, c, at): the choice of every record of ``asks``, given the clusters of the round before.

    ``gives`` is what signatures give, ``grown`` what clusters give through members. Only clusters whose
    first member is not ``gone`` are offered. Of clusters that give a key by their first member alone the
    earliest of a venue is enough, so a key costs a row for each venue.
    """
    alone = gives.join(gone, "node", "left_anti").groupBy("key", "venue").agg(F.min("node").alias("c"))
    # A record that must be elsewhere takes the earliest cluster, or that of the next venue if this is its own.
    nearest = F.row_number().over(Window.partitionBy("key").orderBy("c"))
    alone = alone.withColumn("_n", nearest).where("_n <= 2").select("key", "venue", "c", F.col("c").alias("t"))
    asks = asks.select("node", F.col("venue").alias("own"), "key", "apart", "shared")
    fits = (~F.col("apart") | (F.col("venue") != F.col("own"))) & (F.col("c") != F.col("node"))
    found = asks.where("shared").join(alone, "key").where(fits).select("node", "c", "t").union(asks.join(grown, "key").where(fits).select("node", "c", "t"))
    # Read by both choices below.
    found = keep(found.groupBy("node", "c").agg(F.min("t").alias("t")))
    first = found.where("t < node").groupBy("node").agg(F.min("c").alias("c"))
    # Later copies of a signature leave for an earlier cluster once one has what they ask for.
    about = s.where("last_ord > node").select("node", "last_ord", "merges")
    later = found.where("t >= node").join(about, "node").where("t < last_ord").select("node", "c", "merges", "t")
    later = later.join(first.withColumnRenamed("c", "_f"), "node", "left")
    limit = F.coalesce("_f", F.when(F.col("merges"), F.col("node")), F.lit(2**63 - 1))
    before = F.min("c").over(Window.partitionBy("node").orderBy("t", "c").rowsBetween(Window.unboundedPreceding, -1))
    steps = later.withColumn("_b", before).where(F.col("c") < F.least(limit, F.coalesce("_b", F.lit(2**63 - 1)))).select("node", "c", "t")
    places = records.join(steps, "node").where("ord > t").groupBy("node", "c", "t").agg(F.min("ord").alias("at"))
    return first.select("node", "c", F.col("node").alias("at")).union(places.groupBy("node", "at").agg(F.min("c").alias("c")).select("node", "c", "at"))


def _followed(moved: DataFrame, keep=checkpointed, near: DataFrame | None = None) -> DataFrame:
    """Choices of a cluster whose own first member moved go where that one went; the way halves each time.

    ``near``: the clusters (c) among which the first such one must be, if there is any.
    """
    while True:
        hop = moved.where("at = node").select(F.col("node").alias("c"), F.col("c").alias("to"))
        at_first = hop if near is None else hop.join(near, "c", "left_semi")
        if moved.join(at_first, "c", "left_semi").isEmpty():
            return moved
        near = None
        moved = keep(moved.join(hop, "c", "left").select("node", F.coalesce("to", "c").alias("c"), "at"))


def clusters(df: DataFrame, exact: bool = True) -> DataFrame:
    """(ord, cluster): cluster is the order of the cluster's first record."""
    # The input is read once; every later step starts from the written features. Tables that no later step
    # reads are removed, so the disk holds the features once or twice and one round's tables.
    steps = Steps(df.sparkSession, "reconcile")
    keep = steps.keep
    named, sigs = signatures(keep(features(df, exact)), keep)
    sigs = keep(sigs)
    records = keep(named.join(sigs.select("sig", F.col("first_ord").alias("node")), "sig").select("ord", "node"))
    s = keep(nodes(sigs, keep).drop("sig"))
    steps.only(s, records)
    cited = s.select("node", "region_key", "venue_key", "venue_known", "title_key", "sessions", F.explode("cited").alias("u"))
    bridged = keep(bridged_titles(s, cited))
    telling = keep(telling_urls(s, cited, bridged))
    pairs = keep(url_sessions(s, telling))
    loose = keep(loose_nodes(s, bridged).withColumn("loose", F.lit(True)))
    flagged = lambda rows: rows.join(loose, "node", "left").withColumn("loose", F.coalesce("loose", F.lit(False)))
    open_keys = keep(_open(evidence(flagged(s)).unionByName(url_evidence(flagged(telling)))))
    asks, gives = open_keys.where("asks"), open_keys.where("shared and gives")
    none = keep(s.select("node", F.col("node").alias("c"), F.col("node").alias("at")).where("false"))
    held = (s, records, pairs, open_keys)
    steps.only(*held, none)
    # Without clusters no member gives anything; the second round makes everything that they give.
    found = keep(_decided(_gone(none), s, asks, gives, _grown(none, s, pairs), records, keep))
    steps.only(*held, none, found)
    moved = _followed(found, keep)
    base = keep(_grown(moved, s, pairs))
    steps.only(*held, none, moved, base)
    found = keep(_decided(_gone(moved), s, asks, gives, base, records, keep))
    # Clusters that changed since then, what they give now, and the rows that the last two rounds don't share.
    changed, over, other = keep(none.select("c")), keep(base.where("false")), keep(_unlike(found, moved))
    while not other.isEmpty():
        steps.only(*held, moved, base, changed, over, found, other)
        before, moved = moved, _followed(found, keep, _touched(other))
        alike = moved is found
        if not alike:
            other = keep(_unlike(moved, before))
        fresh = keep(_touched(other))
        old = keep(base.join(changed, "c", "left_anti").unionByName(over).join(fresh, "c", "left_semi"))
        changed = keep(changed.union(fresh).distinct())
        over = keep(_grown(moved.join(changed, "c", "left_semi"), s, pairs))
        askers = _askers(other, open_keys, over.join(fresh, "c", "left_semi"), old, keep)
        own = keep(asks.join(askers, "node", "left_semi"))
        key = keep(own.select("key").distinct())
        offered = keep(gives.join(key, "key", "left_semi"))
        gone = keep(_gone(moved).join(offered.select("node").distinct(), "node", "left_semi"))
        told = keep(base.join(key, "key", "left_semi").join(changed, "c", "left_anti").unionByName(over.join(key, "key", "left_semi")))
        anew = keep(_decided(gone, s, own, offered, told, records, keep))
        found = keep(found.join(askers, "node", "left_anti").union(anew))
        # Where no choice was followed, only the records that chose anew can differ.
        other = keep(_unlike(anew, moved.join(askers, "node", "left_semi")) if alike else _unlike(found, moved))
    # From ``at`` on copies belong to ``c``; those that nothing matches, their own kind included, stand alone.
    start = s.where("merges").select("node", F.col("node").alias("c"), F.col("node").alias("at")).join(moved.where("at = node").select("node"), "node", "left_anti")
    ends = moved.union(start).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "c"))).alias("steps"))
    current = F.element_at(F.filter("steps", lambda x: x["at"] <= F.col("ord")), -1)
    out = keep(records.join(ends, "node", "left").select("ord", F.coalesce(current["c"], F.col("ord")).alias("cluster")))
    steps.only(out)
    return out


def merged(df: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """Merge clusters into long tables: events (facts of the first member), sessions, facts, refs, tickets.

    Sessions keep the fields of the first record that names them; session facts and the references
    gathered by earlier merges (``sourceRefs``) are united.

    Long tables keep a hot cluster spread over rows instead of one wide document.
    """
    tagged = df.join(members, "ord")
    nested = ("ord", "sessions", "urls", "page", "tickets", "sessionFacts", "sourceRefs")
    facts = [c for c in df.columns if c not in nested]
    events = tagged.groupBy("cluster").agg(F.min_by(F.struct(*facts), F.col("ord")).alias("f"), F.count("*").alias("records")).select("cluster", "f.*", "records")
    # The first record that names a session gives its further fields, such as a cancelled status.
    each = tagged.select("cluster", "ord", F.posexplode("sessions").alias("_pos", "s"))
    fields = df.schema["sessions"].dataType.elementType.names
    sessions = each.groupBy("cluster", *[F.col(f"s.{k}").alias(k) for k in ("date", "time")]).agg(
        F.min_by("s", F.struct("ord", "_pos")).alias("s")
    ).select("cluster", "date", "time", *[f"s.{k}" for k in fields if k not in ("date", "time")])
    refs = tagged.select("cluster", "source", "uid")
    if "sourceRefs" in df.columns:
        refs = refs.union(tagged.select("cluster", F.explode("sourceRefs").alias("r")).select("cluster", "r.source", "r.uid"))
    out = {"events": events, "sessions": sessions, "refs": refs.distinct()}
    if "sessionFacts" in df.columns:
        f = tagged.select("cluster", "ord", F.posexplode("sessionFacts").alias("_pos", "f"))
        first = f.groupBy("cluster", F.col("f.date").alias("date"), F.col("f.time").alias("time")).agg(F.min_by("f", F.struct("ord", "_pos")).alias("f"))
        more = [n for n in df.schema["sessionFacts"].dataType.elementType.names if n not in ("date", "time")]
        out["facts"] = first.select("cluster", "date", "time", *[f"f.{n}" for n in more])
    if "tickets" in df.columns:
        t = tagged.select("cluster", "ord", F.posexplode("tickets").alias("pos", "t")).select("cluster", "ord", "pos", "t.*")
        # The first ticket of a URL keeps its price and sale facts; later ones widen its scope.
        rest = [c for c in t.columns if c not in ("cluster", "url", "ord", "pos", "sessions")]
        first = t.groupBy("cluster", "url").agg(F.min_by(F.struct(*rest), F.struct("ord", "pos")).alias("f")).select("cluster", "url", "f.*")
        scope = t.select("cluster", "url", F.explode("sessions").alias("s")).select("cluster", "url", "s.date", "s.time").distinct()
        out |= {"tickets": first, "scopes": scope}
    return out
