"""One group identifier for all records linked directly or indirectly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of the edges with the smallest node of its connected component.

    Alternating large-star and small-star rewrites: large-star links every neighbour greater than a node to
    the smallest of the node and its neighbours, small-star links the neighbours not greater than it, and the node itself,
    to their smallest. Components stay what they are, and after O(log^2 n) rounds every node points at its
    component's minimum. Both are a minimum per node, combined before the shuffle, and a join back: the
    neighbours of a hub (a third of all rows, say) are never gathered, and each round is checkpointed.

    Cases: an edge with a null end is dropped; self-links, repeated and reversed edges change nothing, but a node
    with only a self-link is its own component; no edges give no rows; extra columns are ignored.
    """
    raw = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = raw.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = cut(raw.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        # both directions; the least of a node and its neighbours
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every link points down here: u > v; the least of the smaller neighbours
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        links = cut(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        # converged when nothing changes: every non-root has one link, to a root
        state = links.agg(
            F.count("*").alias("n"), F.countDistinct("u").alias("nu"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if state["n"] == state["nu"] and tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(links, nodes["node"] == links["u"], "left").select("node", F.coalesce("v", "node").alias("component"))


def set_classes(sets: DataFrame, key: str, items: str) -> DataFrame:
    """(key, items, size, class): class is the smallest key of those with the same set (items sorted, distinct, not empty)."""
    h = sets.withColumn("_h", F.sha2(F.to_json(F.struct(items)), 256))
    first = h.groupBy("_h").agg(F.min(key).alias("class"))
    return h.join(first, "_h").select(key, items, F.size(items).alias("size"), "class")


#: Meetings of sets by one item up to which all are looked at; beyond, only those of sets that are not connected yet.
HEAVY = 1_000_000


def contained_pairs(sets: DataFrame, key: str, items: str, min_shared: int, min_part: float) -> DataFrame:
    """(a, b): pairs of sets with at least min_shared common items that make up at least min_part of the smaller set, as many as connect
    all sets that such pairs connect.

    items: sorted distinct non-null arrays. Copies of one set are linked to one of them. If x is the smaller set of a pair, it shares at
    least c = max(min_shared, ceil(min_part * |x|)) items, so one of its |x| - c + 1 rarest items is common: those are met with all items of the
    larger sets, and the met pairs are counted exactly. Hot items are in the rarest part of few sets, so a held-by-all item does not make
    all pairs. Where near copies make an item meet more than HEAVY times, its sets are first compared with its largest one, and then
    only sets of different components meet: those outside the item's commonest component with all, so a group of near copies, of any size,
    costs a few rows a set.
    """
    classes = cut(set_classes(sets.where(F.size(items) >= min_shared), key, items))
    copies = classes.where(F.col(key) != F.col("class")).select(F.col("class").alias("a"), F.col(key).alias("b"))
    one = classes.where(F.col(key) == F.col("class")).select(F.col(key).alias("k"), "size", F.col(items).alias("items"))
    flat = one.select("k", "size", F.explode("items").alias("item"))
    freq = flat.groupBy("item").agg(F.count("*").alias("n"))
    ranked = cut(
        flat.join(freq.where(F.col("n") > 1), "item")  # an item of one set is common to none, and comes first in the order
        .groupBy("k", "size")
        .agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("r"))
    )
    need = F.greatest(F.lit(min_shared), F.ceil(F.col("size") * F.lit(min_part) - 1e-9)).cast("int")
    alone = F.col("size") - F.size("r")
    head = F.col("size") - need + 1 - alone
    rare = ranked.where(head > 0).select("k", "size", need.alias("need"), F.explode(F.slice("r", 1, head)).alias("i")).select("k", "size", "need", F.col("i.item").alias("item"), F.col("i.n").alias("n"))
    other = ranked.select(F.col("k").alias("k2"), F.col("size").alias("size2"), F.explode("r.item").alias("item"))
    heavy = rare.groupBy("item").agg(F.count("*").alias("m"), F.max("n").alias("n")).where(F.col("m") * F.col("n") > HEAVY).select("item")
    heavy = cut(heavy)
    larger = (F.col("k") != F.col("k2")) & ((F.col("size") < F.col("size2")) | ((F.col("size") == F.col("size2")) & (F.col("k") < F.col("k2"))))
    x, y = one.select("k", F.col("items").alias("x")), one.select(F.col("k").alias("k2"), F.col("items").alias("y"))

    def verified(met: DataFrame) -> DataFrame:
        met = met.where(larger).select("k", "k2", "need").distinct()
        return met.join(x, "k").join(y, "k2").where(F.size(F.array_intersect("x", "y")) >= F.col("need")).select(F.col("k").alias("a"), F.col("k2").alias("b"))

    if heavy.isEmpty():
        return verified(rare.join(other, "item")).unionByName(copies)
    mine, theirs = rare.join(heavy, "item", "left_semi"), cut(other.join(heavy, "item", "left_semi"))
    hub = theirs.groupBy("item").agg(F.max_by("k2", F.struct("size2", "k2")).alias("k2"), F.max("size2").alias("size2"))
    first = cut(verified(mine.join(hub, "item")))
    comp = cut(components(first))
    mine = mine.join(comp.select(F.col("node").alias("k"), F.col("component").alias("c")), "k", "left").withColumn("c", F.coalesce("c", "k"))
    theirs = theirs.join(comp.select(F.col("node").alias("k2"), F.col("component").alias("c2")), "k2", "left").withColumn("c2", F.coalesce("c2", "k2"))
    mode = theirs.groupBy("item", "c2").agg(F.count("*").alias("n")).groupBy("item").agg(F.max_by("c2", F.struct("n", "c2")).alias("mode"))
    mine, theirs = mine.join(mode, "item"), theirs.join(mode.select("item", F.col("mode").alias("mode2")), "item")
    apart = F.col("c") != F.col("c2")
    met = mine.where(F.col("c") != F.col("mode")).join(theirs, "item").where(apart).select("k", "k2", "size", "size2", "need")
    met = met.unionByName(mine.where(F.col("c") == F.col("mode")).join(theirs.where(F.col("c2") != F.col("mode2")), "item").where(apart).select("k", "k2", "size", "size2", "need"))
    light = rare.join(heavy, "item", "left_anti").join(other, "item").select("k", "k2", "size", "size2", "need")
    return verified(light.unionByName(met)).unionByName(first).unionByName(copies)


def object_ids(ids: Column) -> Column:
    """Distinct lower 40-digit hex strings, sorted; the rest is damage."""
    low = F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.lower(x))
    return F.array_sort(F.array_distinct(F.filter(low, lambda x: x.isNotNull() & x.rlike("^[0-9a-f]{40}$"))))


def repository_groups(pages: DataFrame, refs: DataFrame, min_shared: int = 2, min_part: float = 0.9) -> DataFrame:
    """(repo, group_id) for every recorded slug of a group with two or more of them; group_id is the smallest of these.

    pages: repo, full_name, fork, parent_full_name, status, fetched_at; refs: repo, ids, error, fetched_at. Ties are the
    rename and the declared fork of a repo's latest ok page and the containment of latest id sets; slugs
    without a record connect, but are no rows. Cases: null and blank slugs tie nothing; null times are the oldest; a page that
    names itself ties nothing; rows delivered twice count once; empty tables give no rows.
    """
    slug = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    page = (
        pages.where((F.col("status") == "ok") & slug("repo").isNotNull())
        .select(slug("repo").alias("repo"), slug("full_name").alias("full"), F.when(F.col("fork"), slug("parent_full_name")).alias("parent"), "fetched_at")
        .groupBy("repo")
        .agg(F.max_by(F.struct("full", "parent"), F.struct("fetched_at", "full", "parent")).alias("r"))
    )
    named = page.select("repo", F.explode(F.array("r.full", "r.parent")).alias("other")).where(F.col("other").isNotNull())
    sets = (
        refs.where(F.col("error").isNull() & slug("repo").isNotNull())
        .select(slug("repo").alias("repo"), object_ids(F.col("ids")).alias("ids"), "fetched_at")
        .where(F.size("ids") > 0)
        .groupBy("repo")
        .agg(F.max_by("ids", F.struct("fetched_at", "ids")).alias("ids"))
    )
    held = contained_pairs(sets, "repo", "ids", min_shared, min_part)
    edges = named.select(F.col("repo").alias("a"), F.col("other").alias("b")).unionByName(held.select("a", "b"))
    comp = components(cut(edges))
    recorded = pages.select(slug("repo").alias("repo")).unionByName(refs.select(slug("repo").alias("repo"))).where(F.col("repo").isNotNull()).distinct()
    mine = recorded.join(comp, recorded["repo"] == comp["node"]).select("repo", "component")
    ids = mine.groupBy("component").agg(F.min("repo").alias("group_id"), F.count("*").alias("n")).where(F.col("n") > 1)
    return mine.join(ids, "component").select("repo", "group_id")
