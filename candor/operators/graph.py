"""The user-product review graph: edges, degrees, co-review statistics, clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.operators import packed
from candor.operators.clean import ROW_KEY
from candor.operators.similarity import overlapping_sets, profile_edges, profiles
from candor.lineage import cut, numbered, written
from candor.skew import attach, tiled_join

CARRIED = 64  # products of a class up to which its rows hold all of them
PIECE = 1024  # entries of a product's histogram that are moved as one array
GATHERED = 1 << 15  # entries that arrive at a class or product up to which they are counted in one task
LOOK_ALIKE = 0.7  # similarity from which two users count as look-alikes


def review_edges(df: DataFrame, *, order: str = ROW_KEY) -> DataFrame:
    """One edge per (user, product): the latest review wins, an undated one counting as latest.

    Users and products stay in separate columns, so an id used on both sides is never merged.
    """
    latest = F.max(F.struct(F.col("date").isNull().alias("undated"), "date", order, "rating")).alias("_l")
    return df.groupBy("user_id", "product_id").agg(latest).select(
        "user_id", "product_id", F.col("_l.rating").alias("rating"), F.col("_l.date").alias("date"),
        F.col(f"_l.{order}").alias(order),
    )


def product_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("product_id").agg(F.count(F.lit(1)).alias("product_degree"))


def bipartite_degrees(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user_id, user_degree, user_neighbors_avg_degree) and (product_id, product_degree)."""
    products = product_degrees(edges)
    users = (
        attach(edges.select("user_id", "product_id"), products, "product_id")
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("user_degree"),
            F.avg("product_degree").alias("user_neighbors_avg_degree"),
        )
    )
    return users, products


def graph_degrees(df: DataFrame, *, order: str = ROW_KEY) -> DataFrame:
    """Degrees attached to the review rows."""
    users, products = bipartite_degrees(review_edges(df, order=order))
    return attach(attach(df, users, "user_id"), products, "product_id")


def coreview_classes(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users with equal product sets, among products with several reviewers, form one class.

    Returns the membership (user_id, profile, members, size) and the class edges.  Class members have the
    same neighbours in the co-review graph and, sharing a product, are neighbours themselves.
    """
    degrees = product_degrees(edges)
    shared = (
        attach(edges.select("user_id", "product_id"), degrees, "product_id")
        .filter(F.col("product_degree") > 1)
        .select("user_id", "product_id")
    )
    membership = written(profiles(shared, "user_id", "product_id"), "classes")
    return membership, written(profile_edges(shared, membership, "user_id"), "class-edges")


def _class_pairs(own: DataFrame, carried: int = CARRIED) -> DataFrame:
    """Pairs of classes that share a product: (set_1 < set_2, members_1, members_2, weight).

    A class of at most ``carried`` products takes all of them along, so two such classes are counted where they meet on the first product
    they share, and their pairs, far more than the rows, are not moved.  Only pairs with a larger class are gathered to be counted.
    """
    few = own.filter(F.col("size") <= carried)
    items = few.groupBy("profile").agg(F.sort_array(F.collect_list("product_id")).alias("items"))
    rows = written(attach(few.select("profile", "product_id", "members"), items, "profile", how="inner"), "class-products")
    side = lambda df, n: df.select("product_id", *[F.col(c).alias({"profile": "set"}.get(c, c) + n) for c in df.columns if c != "product_id"])
    met = tiled_join(side(rows, "_1"), side(rows, "_2"), "product_id").filter(F.col("set_1") < F.col("set_2"))
    columns = ["set_1", "set_2", "members_1", "members_2", "weight"]
    counted = (
        met.withColumn("_shared", F.array_intersect("items_1", "items_2"))
        .filter(F.element_at("_shared", 1) == F.col("product_id"))
        .withColumn("weight", F.size("_shared").cast("long"))
        .select(*columns)
    )
    large = own.filter(F.col("size") > carried).select("profile", "product_id", "members")
    if large.isEmpty():
        return counted
    every = own.select("profile", "product_id", "members", (F.col("size") > carried).alias("large"))
    once = ~F.col("large_2") | (F.col("set_1") < F.col("set_2"))  # two large classes meet twice
    ordered = lambda c: F.when(F.col("set_1") < F.col("set_2"), F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))
    other = lambda c: F.when(F.col("set_1") < F.col("set_2"), F.col(f"{c}_2")).otherwise(F.col(f"{c}_1"))
    gathered = (
        tiled_join(side(large, "_1"), side(every, "_2"), "product_id")
        .filter(once)
        .select(*[f(c).alias(c + n) for c in ("set", "members") for n, f in (("_1", ordered), ("_2", other))])
        .groupBy("set_1", "set_2")
        .agg(F.max("members_1").alias("members_1"), F.max("members_2").alias("members_2"), F.count(F.lit(1)).alias("weight"))
    )
    return counted.unionByName(gathered)


def coreview_edges(edges: DataFrame) -> DataFrame:
    """The co-review graph between classes of users: weight = number of shared products.

    Every member of ``user_1``'s class is linked to every member of ``user_2``'s; a class with several members
    is also linked to itself.
    """
    membership, own = coreview_classes(edges)
    classes = membership.filter(F.col("user_id") == F.col("profile")).select("profile", "members", "size")
    across = _class_pairs(own)
    within = classes.filter(F.col("members") > 1).select(
        F.col("profile").alias("set_1"), F.col("profile").alias("set_2"), F.col("members").alias("members_1"),
        F.col("members").alias("members_2"), F.col("size").alias("weight"),
    )
    return across.union(within).withColumnsRenamed({"set_1": "user_1", "set_2": "user_2"})


def coreview_factors(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The co-review graph in factors, whose size follows the reviews and not the pairs.

    * (user_id, profile): the class of each user;
    * (profile, product_id, members): the products of each class, one row per edge of a class at most;
    * (user_1, user_2, weight): classes that share two products or more, with their number.

    Two classes are linked if they share a product; their weight is that of the third table, else 1.  A class of several members is
    linked to itself, with the number of its products.  :func:`coreview_edges` is what that multiplies out to.
    """
    membership, own = coreview_classes(edges)
    links = overlapping_sets(own, "profile", "product_id").select(
        F.col("set_1").alias("user_1"), F.col("set_2").alias("user_2"), F.col("shared").alias("weight")
    )
    return membership.select("user_id", "profile"), own.select("profile", "product_id", "members"), links


def user_similarity_stats(edges: DataFrame) -> DataFrame:
    """Per user: number of co-reviewers, mean and maximum Jaccard similarity with them (0 if there are none).

    Not computed over co-reviewer pairs.  A pair that shares exactly one product contributes
    ``1 / (d1 + d2 - 1)``, which depends on the two degrees only, so per product a histogram of reviewer
    degrees is enough (a product with k distinct degrees has at least k^2 / 2 edges behind it, so pairs of
    degrees are at most linear in the edges).  Only pairs that share two or more products are looked at
    one by one, to correct what the histograms counted for them.
    """
    pairs = edges.select("user_id", "product_id")
    degree = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("d"))
    placed = attach(pairs, degree, "user_id")
    hist = placed.groupBy("product_id", "d").agg(F.count(F.lit(1)).alias("n"))
    other = hist.select("product_id", F.col("d").alias("d2"), F.col("n").alias("n2"))
    others = F.col("n2") - F.when(F.col("d") == F.col("d2"), 1).otherwise(0)
    single = 1.0 / (F.col("d") + F.col("d2") - 1)
    per_degree = (
        hist.join(other, "product_id")
        .groupBy("product_id", "d")
        .agg(
            F.sum(others).alias("links"),
            F.sum(others * single).alias("sum_single"),
            F.max(F.when(others > 0, single)).alias("max_single"),
        )
    )
    base = (
        attach(placed, per_degree, ["product_id", "d"])
        .groupBy("user_id")
        .agg(F.max("d").alias("d"), F.sum("links").alias("links"), F.sum("sum_single").alias("total"), F.max("max_single").alias("best"))
    )
    membership = written(profiles(pairs, "user_id", "product_id"), "classes")
    own = written(profile_edges(pairs, membership, "user_id"), "class-edges")
    strong = overlapping_sets(own, "profile", "product_id")
    directed = strong.select(
        F.col("set_1").alias("profile"), F.col("size_1").alias("a"), F.col("size_2").alias("b"), "shared", F.col("members_2").alias("m")
    ).union(strong.select("set_2", "size_2", "size_1", "shared", "members_1"))
    # Members of one class share all their d products with each other.
    twins = membership.filter((F.col("user_id") == F.col("profile")) & (F.col("members") > 1) & (F.col("size") > 1)).select(
        "profile", F.col("size").alias("a"), F.col("size").alias("b"), F.col("size").alias("shared"), (F.col("members") - 1).alias("m")
    )
    c, a, b = F.col("shared"), F.col("a"), F.col("b")
    correction = (
        directed.union(twins)
        .groupBy("profile")
        .agg(
            F.sum(F.col("m") * (c - 1)).alias("links_over"),
            F.sum(F.col("m") * (c / (a + b - c) - c / (a + b - 1))).alias("total_fix"),
            F.max(c / (a + b - c)).alias("best_strong"),
        )
    )
    fixes = attach(membership.select("user_id", "profile"), correction, "profile").drop("profile")
    n = F.col("links") - F.coalesce("links_over", F.lit(0))
    return (
        base.join(fixes, "user_id", "left")
        .select(
            "user_id",
            F.when(n > 0, (F.col("total") + F.coalesce("total_fix", F.lit(0.0))) / n).otherwise(0.0).alias("avg_user_similarity"),
            F.coalesce(F.greatest("best", "best_strong"), F.lit(0.0)).alias("max_user_similarity"),
            n.cast("double").alias("similar_user_count"),
        )
    )


def _lists(rows: DataFrame, key: str, width: str, values: list[str], piece: int) -> DataFrame:
    """The ``values`` of each key as arrays, in pieces of about ``piece`` entries; column ``width`` tells how many the key has."""
    part = F.pmod(F.xxhash64(values[0]), F.ceil(F.col(width) / piece))
    held = rows.groupBy(key, part.alias("_part")).agg(F.sort_array(F.collect_list(F.struct(*values))).alias("_all"))
    return held.select(key, *[F.col("_all")[v].alias(v) for v in values])


def _packed(rows: DataFrame) -> DataFrame:
    """Rows with the arrays ``item`` and ``n`` packed."""
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c not in ("item", "n"))
    return rows.mapInArrow(packed.packed_rows, f"{kinds}, {packed.ITEMS}")


def _by_key(rows: DataFrame, key: str) -> DataFrame:
    """Lists (key, item, n), those of a key in one task and one behind the other."""
    return rows.select(key, "item", "n").repartition(key).sortWithinPartitions(key)


def _entries(rows: DataFrame, key: str) -> DataFrame:
    """(key, item, n): the lists of each key added up, entry by entry."""
    return rows.select(key, "item", "n").mapInArrow(packed.entries, f"{key} long, item long, n long").groupBy(key, "item").agg(F.sum("n").alias("n"))


def _histograms(sent: DataFrame, piece: int) -> DataFrame:
    """(at, item, n, len): what was sent to each ``at`` added up, in packed lists of about ``piece`` entries.  ``few`` tells where few entries arrive."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ends, item, n in packed.summed(batches):
            parts = np.ceil(np.diff(ends, prepend=0) / piece).astype(np.int64)
            nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            stops = np.minimum(np.repeat(np.r_[0, ends[:-1]], parts) + (nth + 1) * piece, np.repeat(ends, parts))
            columns = [pa.array(np.repeat(key, parts)), *packed.pack(item, n, stops), pa.array(np.diff(stops, prepend=0))]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "item", "n", "len"])

    few = _by_key(sent.filter("few"), "at").mapInArrow(counted, f"at long, {packed.ITEMS}, len long")
    counts = written(_entries(sent.filter("NOT few"), "at"), "counts")
    width = counts.groupBy("at").agg(F.count(F.lit(1)).alias("width"))
    many = _lists(attach(counts, width, "at"), "at", "width", ["item", "n"], piece).withColumn("len", F.size("item").cast("long"))
    return few.unionByName(_packed(many))


def _links_around(sent: DataFrame) -> DataFrame:
    """(set_1, twice): twice the pairs of neighbours that share a product, counted product by product.

    ``sent`` holds packed lists (set_1, item, n): products, and what is to be added to their numbers of neighbours.  Where ``few`` entries arrive,
    they are counted in a task as they come, so that lists are moved and not their entries; the others are counted entry by entry.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ends, _, n in packed.summed(batches):
            upto = np.r_[0, np.cumsum(n * (n - 1))]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(upto[ends] - upto[np.r_[0, ends[:-1]]])], names=["set_1", "twice"])

    few = _by_key(sent.filter("few"), "set_1").mapInArrow(counted, "set_1 long, twice long")
    many = _entries(sent.filter("NOT few"), "set_1").groupBy("set_1").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("twice"))
    return few.unionByName(many)


def user_clustering(edges: DataFrame, focus: DataFrame | None = None, *, most: int = GATHERED, piece: int = PIECE) -> DataFrame:
    """Clustering coefficient of every user in the co-review graph: 2T / (d (d - 1)), 0 below two neighbours.

    With ``focus`` (user_id) only of these users; ``edges`` must then hold all edges of theirs and of their co-reviewers.

    Links among the neighbours of a user are counted product by product: a product that x of the neighbours
    reviewed links C(x, 2) of them; links that several products repeat are taken off again, which only
    concerns pairs that share two or more products.  All of it runs on user classes with multiplicities.

    Neighbours are not listed.  A product holds a histogram of what its reviewers reviewed, and a class adds up those of its products; who
    shares c of them is then counted c times, which again only concerns pairs that share two or more.  So a histogram is moved for each
    edge, in packed lists of about ``piece`` entries, and a class or product at which at most ``most`` entries arrive is counted in a task.
    """
    membership, own = coreview_classes(edges)
    reps = membership.filter(F.col("user_id") == F.col("profile")).select("profile", "members", "size")
    named = numbered(reps, "c", "named")
    classes = named.select("c", "members", "size")
    wanted = None
    if focus is not None:
        asked = attach(membership, focus.select("user_id"), "user_id", how="inner").select("profile").distinct()
        wanted = written(attach(named, asked, "profile", how="left_semi").select("c"), "wanted")
    among = lambda df, key: df if wanted is None else attach(df, wanted.withColumnRenamed("c", key), key, how="left_semi")
    numbers = numbered(own.select("product_id").distinct(), "at", "products")
    rows = attach(own.select("profile", "product_id"), numbers, "product_id", how="inner").select("profile", "at")
    rows = written(attach(rows, named, "profile", how="inner").select("c", "at", "members", "size"), "numbered")
    asked = among(rows.withColumnRenamed("c", "set_1"), "set_1")
    bought = written(_lists(rows.withColumn("item", F.col("at")), "c", "size", ["item"], CARRIED), "class-items")
    bought = attach(bought, classes, "c", how="inner")
    of_all = lambda n: F.transform("item", lambda _: n.cast("long")).alias("n")

    # What the reviewers of a product reviewed: (at, item, n), lists that also serve to count their members and twins.
    spare = lambda m, s: (m * (m - 1) / 2 * (s - 1)).cast("long")  # noqa: E731  # links among twins that products repeat
    m, s = F.col("members"), F.col("size")
    arriving = rows.groupBy("at").agg(F.sum("size").alias("entries"), F.sum("members").alias("around"), F.sum(spare(m, s)).alias("spare"))
    arriving = written(arriving.withColumn("few", F.col("entries") <= most), "arriving")
    own_lists = _packed(bought.select("c", "size", "item", of_all(m), F.col("item").alias("to")))
    # A class of one list sends it to each product in it; the products of a larger one meet all of its lists.
    sent = own_lists.filter(s <= CARRIED).select(F.explode("to").alias("at"), "item", "n")
    large = attach(rows.filter(s > CARRIED).select("c", "at"), own_lists.filter(s > CARRIED).select("c", "item", "n"), "c", how="inner")
    sent = attach(sent.union(large.select("at", "item", "n")), arriving.select("at", "few"), "at", how="inner")
    lists = written(_histograms(sent, piece), "lists")
    width = lists.groupBy("at").agg(F.sum("len").alias("width"))
    product = arriving.select("at", "around", "spare").join(width, "at")

    # Strong pairs, both ways: the other class is counted ``again`` times too often.
    strong = written(overlapping_sets(rows, "c", "at"), "strong")
    again = (F.col("shared") - 1).alias("again")
    twice = strong.select("set_1", F.col("set_2").alias("c"), F.col("members_2").alias("m"), F.col("size_2").alias("s"), again)
    twice = written(among(twice.union(strong.select("set_2", "set_1", "members_1", "size_1", again)), "set_1"), "twice")
    less = twice.groupBy("set_1").agg(
        F.sum(F.col("again") * F.col("m")).alias("around_less"), F.sum(F.col("again") * spare(F.col("m"), F.col("s"))).alias("spare_less"),
        F.sum("s").alias("entries"),
    )
    # A class meets itself at each of its products, and once its other members are neighbours.
    totals = (
        attach(asked, product, "at")
        .groupBy("set_1")
        .agg(*[F.sum(c).alias(c) for c in ("around", "spare", "width")], F.max("members").alias("members"), F.max("size").alias("size"))
        .join(less, "set_1", "left")
        .fillna(0, subset=["around_less", "spare_less", "entries"])
        .select(
            "set_1", ((F.col("width") + F.col("entries") + s) <= most).alias("few"),
            (F.col("around") - s * m - F.col("around_less")).alias("d_out"), (F.col("spare") - s * spare(m, s) - F.col("spare_less")).alias("over_twins"),
        )
    )
    totals = written(totals, "around")
    few = totals.select("set_1", "few")
    around = attach(attach(asked.select("set_1", "at"), few, "set_1", how="inner"), lists, "at", how="inner")
    themselves = among(bought.select(F.col("c").alias("set_1"), "item", of_all(m - 1 - s * m)), "set_1")
    repeated = attach(twice, bought.select("c", "item"), "c", how="inner").select("set_1", "item", of_all(-F.col("again") * F.col("m")))
    less_again = attach(_packed(themselves.union(repeated)), few, "set_1", how="inner")
    columns = ["set_1", "few", "item", "n"]
    reached = written(_links_around(around.select(*columns).union(less_again.select(*columns))), "reached")

    # Repeated links between two other classes, both neighbours of set_1 ...
    ends = strong.select(F.col("set_1").alias("profile")).union(strong.select("set_2")).distinct()
    by_name = rows.select(F.col("c").alias("profile"), F.col("at").alias("product_id"))
    linked = _neighbours(by_name, ends).select(F.col("set_1").alias("y"), F.col("set_2").alias("set_1"))
    linked = written(among(linked.distinct(), "set_1"), "linked")
    between = (
        linked.join(strong.select(F.col("set_1").alias("y"), F.col("set_2").alias("z"), "members_1", "members_2", "shared"), "y")
        .join(linked.withColumnRenamed("y", "z"), ["set_1", "z"])
        .select("set_1", (F.col("members_1") * F.col("members_2") * (F.col("shared") - 1)).alias("over"))
    )
    # ... and between the user's own twins and a neighbouring class.
    with_twins = strong.select("set_1", ((F.col("members_1") - 1) * F.col("members_2") * (F.col("shared") - 1)).alias("over")).union(
        strong.select("set_2", (F.col("members_2") - 1) * F.col("members_1") * (F.col("shared") - 1))
    )
    over = written(between.union(with_twins).groupBy("set_1").agg(F.sum("over").alias("over")), "over")

    zero = F.lit(0)
    degree = F.coalesce("d_out", zero) + m - 1
    triangles = (
        F.coalesce("twice", zero) / 2
        - F.coalesce("over", zero)
        - F.coalesce("over_twins", zero)
        - (m - 1) * (m - 2) / 2 * (s - 1)
    )
    per_class = (
        among(named, "c").withColumnRenamed("c", "set_1")
        .join(reached, "set_1", "left")
        .join(totals, "set_1", "left")
        .join(over, "set_1", "left")
        .select("profile", F.when(degree >= 2, 2.0 * triangles / (degree * (degree - 1.0))).otherwise(0.0).alias("user_clustering"))
    )
    values = attach(membership.select("user_id", "profile"), per_class, "profile").drop("profile")
    everyone = (edges if focus is None else focus).select("user_id").distinct()
    return everyone.join(values, "user_id", "left").fillna(0.0, subset=["user_clustering"])


def _neighbours(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of wanted profiles met by the rows of all others on the same product (columns get the suffixes _1 and _2)."""
    side = lambda df, n: df.select("product_id", *[F.col(c).alias("set" + n if c == "profile" else c + n) for c in df.columns if c != "product_id"])
    mine = written(attach(own, wanted, "profile", how="inner"), "mine")
    return tiled_join(side(mine, "_1"), side(own, "_2"), "product_id").filter(F.col("set_1") != F.col("set_2"))


def focused_user_features(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """Degree, clustering, co-reviewer similarity and the look-alike flag of the users in ``focus`` (user_id, distinct).

    ``edges`` must hold all edges of these users and of their co-reviewers; other edges do no harm.  Values are those that
    ``bipartite_degrees``, ``user_clustering``, ``user_similarity_stats`` and ``suspicious_users`` give over the whole graph.
    Users alike in everything are compared once, as a profile.
    """
    membership = cut(profiles(edges, "user_id", "product_id", ("rating",)))
    own = cut(profile_edges(edges.select("user_id", "product_id", "rating"), membership, "user_id"))
    mine = attach(membership, focus.select("user_id"), "user_id", how="inner")
    pairs = (
        _neighbours(own, mine.select("profile").distinct())
        .groupBy("set_1", "set_2")
        .agg(
            F.count(F.lit(1)).alias("c"), F.max("size_1").alias("a"), F.max("size_2").alias("b"), F.max("members_2").alias("m"),
            F.avg(1.0 - F.abs(F.col("rating_1") - F.col("rating_2")) / 5.0).alias("agree"),
        )
        .withColumn("jaccard", F.col("c") / (F.col("a") + F.col("b") - F.col("c")))
    )
    met = pairs.groupBy(F.col("set_1").alias("profile")).agg(
        F.sum("m").alias("links"), F.sum(F.col("m") * F.col("jaccard")).alias("total"), F.max("jaccard").alias("best"),
        F.max((F.col("jaccard") + F.col("agree")) / 2 >= LOOK_ALIKE).alias("alike"),
    )
    twins, zero = F.col("members") - 1, F.lit(0.0)
    links = F.coalesce("links", F.lit(0)) + twins
    stats = attach(mine, met, "profile").select(
        "user_id", F.col("size").alias("user_degree"),
        F.when(links > 0, (F.coalesce("total", zero) + twins) / links).otherwise(0.0).alias("avg_user_similarity"),
        F.greatest(F.coalesce("best", zero), F.when(twins > 0, 1.0).otherwise(0.0)).alias("max_user_similarity"),
        links.cast("double").alias("similar_user_count"),
        F.when((twins > 0) | F.col("alike"), 1.0).alias("is_suspicious_user"),
    )
    return stats.join(user_clustering(edges, focus), "user_id", "left")
