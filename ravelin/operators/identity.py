"""Which names are one repository, and which of them stands for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.uris import is_forge_node
from ..runtime import cut
from .graph import components
from .overlap import containment

#: Meetings of origins by one object id up to which all are looked at; beyond, only those of origins that don't hang together yet.
HEAVY = 1_000_000


def same_refs(refs: DataFrame, key: str = "origin", item: str = "object_id", min_shared: int = 2, least: float = 0.9, heavy: int = HEAVY) -> DataFrame:
    """(a, b): keys a < b with at least min_shared common items that make up at least `least` of the smaller key's, as many as connect
    all keys that such pairs connect. No item is passed over.

    With the items that others hold too, the rarest first, the first common one of a pair is among all but the last need - 1 of the smaller key,
    need being the common items it must have, and at least need items of the larger key are left from there on. Keys meet by such items, hashed, and
    those that met are counted by the items themselves. An item by which more than `heavy` pairs meet first brings its keys together with its
    largest one; then only keys that don't hang together by that meet, so near copies in any number cost a few rows each. Pairs by such items
    come both ways round, since not all pairs of their keys come.
    """
    known = refs.where(F.col(key).isNotNull() & F.col(item).isNotNull())
    sets = cut(known.groupBy(F.col(key).alias("l")).agg(F.collect_set(item).alias("ids")).where(F.size("ids") >= min_shared))
    flat = sets.select("l", F.size("ids").alias("k"), F.explode("ids").alias("i")).select("l", "k", F.xxhash64("i").alias("i"))
    held = flat.withColumn("n", F.count("*").over(Window.partitionBy("i"))).where(F.col("n") > 1)
    need = F.greatest(F.lit(min_shared), F.ceil(F.col("k") * F.lit(least) - 1e-9)).cast("int")
    ranked = cut(held.groupBy("l", "k").agg(F.array_sort(F.collect_list(F.struct("n", "i"))).alias("r")).where(F.size("r") >= min_shared).withColumn("need", need))
    early = ranked.where(F.size("r") >= F.col("need")).select("l", "k", "need", F.explode(F.slice("r", F.lit(1), F.size("r") - F.col("need") + 1)).alias("v")).select("l", "k", "need", "v.*")
    later = ranked.select(F.col("l").alias("o"), F.col("k").alias("ko"), F.size("r").alias("s"), F.posexplode("r").alias("p", "v")).select("o", "ko", F.col("v.i").alias("i"), (F.col("s") - F.col("p")).alias("left"))
    later = later.where(F.col("left") >= min_shared)
    plain = (lambda c: F.transform(c, F.hex)) if refs.schema[item].dataType.typeName() == "binary" else F.col  # arrays of bytes are intersected item by item

    def same(met: DataFrame) -> DataFrame:
        met = met.where((F.col("left") >= F.col("need")) & (F.struct("k", "l") < F.struct("ko", "o"))).select("l", "o", "k").distinct()
        both = met.join(sets.select("l", F.col("ids").alias("x")), "l").join(sets.select(F.col("l").alias("o"), F.col("ids").alias("y")), "o")
        got = both.select("l", "o", "k", F.size(F.array_intersect(plain("x"), plain("y"))).alias("c"))
        return got.where((F.col("c") >= min_shared) & (F.col("c") / F.col("k") >= least)).select(F.least("l", "o").alias("a"), F.greatest("l", "o").alias("b"))

    hot = cut(early.groupBy("i").agg(F.count("*").alias("m"), F.max("n").alias("n")).where(F.col("m") * F.col("n") > heavy).select("i"))
    if hot.isEmpty():
        return same(early.join(later, "i"))
    x, y = cut(early.join(hot, "i", "left_semi")), cut(later.join(hot, "i", "left_semi"))
    largest = y.groupBy("i").agg(F.max_by(F.struct("o", "ko", "left"), F.struct("ko", "o")).alias("v")).select("i", "v.*")
    first = cut(same(x.join(largest, "i")))
    comp = cut(components(first))
    x = x.join(comp.select(F.col("node").alias("l"), F.col("component").alias("c")), "l", "left").withColumn("c", F.coalesce("c", "l"))
    y = y.join(comp.select(F.col("node").alias("o"), F.col("component").alias("co")), "o", "left").withColumn("co", F.coalesce("co", "o"))
    most = y.groupBy("i", "co").agg(F.count("*").alias("n")).groupBy("i").agg(F.max_by("co", F.struct("n", "co")).alias("most"))
    x, y = x.join(most, "i"), y.join(most, "i").withColumnRenamed("most", "most_o")
    inside, cols = F.col("c") == F.col("most"), ["l", "o", "k", "ko", "need", "left"]
    rest = x.where(~inside).join(y, "i").where(F.col("c") != F.col("co")).select(*cols)
    rest = rest.unionByName(x.where(inside).join(y.where(F.col("co") != F.col("most_o")), "i").select(*cols))
    hung = cut(first.unionByName(same(rest)))
    return same(early.join(hot, "i", "left_anti").join(later, "i")).unionByName(hung).unionByName(hung.select(F.col("b").alias("a"), F.col("a").alias("b")))


def declared(pages: DataFrame) -> DataFrame:
    """(a, b, reason): ties between lower slugs by rename and declared fork."""
    p = pages.select(F.lower("repo").alias("a"), F.lower("full_name").alias("n"), F.when(F.col("fork"), F.lower("parent_full_name")).alias("f"))
    rename = p.where(F.col("n").isNotNull() & (F.col("n") != F.col("a"))).select("a", F.col("n").alias("b"), F.lit("rename").alias("reason"))
    fork = p.where(F.col("f").isNotNull() & (F.col("f") != F.col("a"))).select("a", F.col("f").alias("b"), F.lit("fork").alias("reason"))
    return rename.unionByName(fork)


def evidence(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """(a, b, reason): ties between lower slugs by rename, declared fork and shared refs, of the latter as many as connect all.

    pages: repo, full_name, fork, parent_full_name (one row per repo); refs: origin, object_id.
    """
    low = refs.select(F.lower("origin").alias("origin"), "object_id")
    held = same_refs(low).select("a", "b", F.lit("refs").alias("reason"))
    return declared(pages).unionByName(held)


def groups(members: DataFrame, ties: DataFrame, key: str = "repo") -> DataFrame:
    """(repo, group): every member with its component; one without ties is its own."""
    comp = components(ties.select("a", "b"))
    return members.select(key).distinct().join(comp, F.lower(key) == F.col("node"), "left").select(key, F.coalesce("component", F.lower(key)).alias("group"))


def canonical(grouped: DataFrame, pages: DataFrame, key: str = "repo") -> DataFrame:
    """(group, canonical, canonical_by): the sole member that is no fork and that some full_name of the group names; else the sole declared fork source
    within the group; else the first by (fork, archived, most stars, oldest, name)."""
    cols = ["full_name", "fork", "parent_full_name", "archived", "stargazers_count", "created_at"]
    g = grouped.join(pages.select(F.lower(key).alias("_k"), *cols), F.lower(grouped[key]) == F.col("_k"), "left").drop("_k")
    by_name = g.select("group", F.lower(key).alias("_n"), F.col(key).alias("_member"), F.coalesce("fork", F.lit(False)).alias("_fork"))
    named = g.where(F.col("full_name").isNotNull()).select("group", F.lower("full_name").alias("_n")).distinct().join(by_name, ["group", "_n"]).where(~F.col("_fork"))
    source = g.where(F.col("fork") & F.col("parent_full_name").isNotNull()).select("group", F.lower("parent_full_name").alias("_n")).distinct().join(by_name, ["group", "_n"])
    sole = lambda df, out: df.groupBy("group").agg(F.countDistinct("_member").alias("_c"), F.min("_member").alias(out)).where(F.col("_c") == 1).select("group", out)
    rank = F.struct(
        F.coalesce("fork", F.lit(False)).alias("f"), F.coalesce("archived", F.lit(False)).alias("a"), (-F.coalesce("stargazers_count", F.lit(0))).alias("s"), F.coalesce("created_at", F.lit("9999")).alias("c"), F.col(key).alias("k")
    )
    best = g.groupBy("group").agg(F.min_by(key, rank).alias("_ranked"))
    all_ = best.join(sole(named, "_named"), "group", "left").join(sole(source, "_source"), "group", "left")
    return all_.select(
        "group",
        F.coalesce("_named", "_source", "_ranked").alias("canonical"),
        F.when(F.col("_named").isNotNull(), "full_name").when(F.col("_source").isNotNull(), "fork source").otherwise("ranked").alias("canonical_by"),
    )


def alias_table(grouped: DataFrame, canon: DataFrame, key: str = "repo") -> DataFrame:
    return grouped.join(canon, "group").where(F.col(key) != F.col("canonical")).select(F.col(key).alias("alias"), F.col("canonical").alias("canon"))


def records(grouped: DataFrame, canon: DataFrame, pages: DataFrame, ties: DataFrame, mirrors: DataFrame | None = None, key: str = "repo") -> DataFrame:
    """(canonical, canonical_by, origins, aliases, merged_by): the record of each group.

    An origin is a struct (url, forge, slug, role): canonical, fork or duplicate of the members, mirrored-from of verified mirrors (slug, url).
    """
    p = pages.select(F.lower(key).alias("_k"), F.col("full_name").alias("_full"), F.coalesce("fork", F.lit(False)).alias("_fork"))
    m = grouped.join(canon, "group").join(p, F.lower(grouped[key]) == F.col("_k"), "left")
    forge = is_forge_node(F.col(key))
    role = F.when(F.col(key) == F.col("canonical"), "canonical").when(~forge & F.col("_fork"), "fork").otherwise("duplicate")
    origin = m.select(
        "group",
        F.when(forge, F.concat(F.lit("https://"), key)).otherwise(F.concat(F.lit("https://github.com/"), F.coalesce("_full", key))).alias("url"),
        F.when(forge, F.substring_index(key, "/", 1)).otherwise("github").alias("forge"),
        F.col(key).alias("slug"),
        role.alias("role"),
    )
    if mirrors is not None:
        origin = origin.unionByName(
            mirrors.join(grouped, F.lower(mirrors["slug"]) == F.lower(grouped[key])).select("group", "url", F.lit("other").alias("forge"), F.lit(None).cast("string").alias("slug"), F.lit("mirrored-from").alias("role"))
        )
    o = origin.groupBy("group").agg(F.array_sort(F.collect_set(F.struct("url", "forge", "slug", "role"))).alias("origins"))
    al = m.where(F.col(key) != F.col("canonical")).groupBy("group").agg(F.array_sort(F.collect_set(key)).alias("aliases"))
    why = ties.join(grouped.select(F.lower(key).alias("a"), "group"), "a").groupBy("group").agg(F.array_sort(F.collect_set("reason")).alias("merged_by"))
    none = F.array().cast("array<string>")
    return canon.join(o, "group").join(al, "group", "left").join(why, "group", "left").select("canonical", "canonical_by", "origins", F.coalesce("aliases", none).alias("aliases"), F.coalesce("merged_by", none).alias("merged_by"))


def verified_mirrors(candidates: DataFrame, refs: DataFrame, min_shared: int = 2, least: float = 0.9) -> DataFrame:
    """Curated (a, b) pairs with their counts, `accepted`, and why not."""
    known = refs.select(F.col("origin").alias("_o")).distinct()
    both = candidates.join(known.withColumnRenamed("_o", "a").withColumn("_ha", F.lit(True)), "a", "left").join(known.withColumnRenamed("_o", "b").withColumn("_hb", F.lit(True)), "b", "left")
    got = containment(candidates, refs)
    full = both.join(got, ["a", "b"], "left")
    why = F.when(F.col("_ha").isNull() | F.col("_hb").isNull(), "refs not known").when(F.col("shared") < min_shared, "too few shared refs").when(F.col("containment") < least, "contains too little")
    return full.select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"), "containment", why.isNull().alias("accepted"), why.alias("reason"))


def new_origins(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(repo, url) of the current record and those of the previous one whose url it lacks."""
    return current.select("repo", "url").unionByName(previous.select("repo", "url").join(current.select("repo", "url"), ["repo", "url"], "left_anti"))
