"""Names to nodes: alias and casing lookups, coordinate joins, merges of tables and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import name_variants, version_candidates, version_core, version_matches
from ..runtime import cut, running_sum


def lookup(nodes: DataFrame, aliases: DataFrame, node: str = "node", alias: str = "alias", canon: str = "canon") -> DataFrame:
    """(key, node): every lower name that means a node: its own, or that of an alias whose canonical name is a node."""
    own = nodes.where(F.col(node).isNotNull()).groupBy(F.lower(node).alias("key")).agg(F.min(node).alias("node"))
    other = aliases.select(F.lower(alias).alias("_a"), F.lower(canon).alias("key")).where(F.col("_a").isNotNull())
    via = other.join(own, "key").groupBy(F.col("_a").alias("key")).agg(F.min("node").alias("node"))
    # an alias goes to its canonical node even where it is itself a node
    return own.join(via, "key", "left_anti").unionByName(via)


def resolved(df: DataFrame, column: str, table: DataFrame, out: str, how: str = "left") -> DataFrame:
    """df with the node that column means, cased as the node set has it; null (or dropped, how='inner') where it means none."""
    t = table.select(F.col("key").alias("_key"), F.col("node").alias(out))
    return df.withColumn("_key", F.lower(column)).join(t, "_key", how).drop("_key")


def canonical_ids(ids: DataFrame, nodes: DataFrame, aliases: DataFrame, column: str = "node") -> DataFrame:
    """Distinct ids after alias collapse, cased as the nodes; ids that mean no node stay as they are."""
    got = resolved(ids.select(column), column, lookup(nodes, aliases), "_n")
    return got.select(F.coalesce("_n", column).alias(column)).distinct()


def coordinate_edges(deps: DataFrame, resolution: DataFrame, nodes: DataFrame, source: str = "repo", coord: str = "coord") -> DataFrame:
    """(a, b, coord): source nodes a and the nodes b their coordinates resolve to; off-cohort targets and self-loops are dropped.

    nodes is a lookup() table. Distinct coordinates are resolved once, before they meet the dependencies.
    """
    target = resolved(resolution.select(coord, F.col("repo").alias("_r")).distinct(), "_r", nodes, "b", "inner").select(coord, "b")
    return resolved(deps.select(F.col(source).alias("_s"), coord), "_s", nodes, "a", "inner").join(target, coord).where(F.col("a") != F.col("b")).select("a", "b", coord).distinct()


def without_own(deps: DataFrame, published: DataFrame, by: Sequence[str]) -> DataFrame:
    """Dependencies that are not on what the same source publishes; put before resolution, so own coordinates are never looked up."""
    return deps.join(published.select(*by).distinct(), list(by), "left_anti")


def either_order(ids: DataFrame, known: DataFrame, column: str = "raw_id", key: str = "repo") -> DataFrame:
    """(raw_id, repo): 'x/y' as it is if known, else as 'y/x'."""
    x, y = F.substring_index(F.col(column), "/", 1), F.substring_index(F.col(column), "/", -1)
    tries = ids.select(column, F.posexplode(F.array(F.concat_ws("/", x, y), F.concat_ws("/", y, x))).alias("rank", "_try"))
    k = known.select(F.lower(key).alias("_k"), F.col(key).alias("_repo")).distinct()
    hit = tries.join(k, F.lower("_try") == F.col("_k"))
    return hit.groupBy(column).agg(F.min_by("_repo", F.struct("rank", "_repo")).alias(key))


def merged_fields(older: DataFrame, newer: DataFrame, key: str, fields: Sequence[str], strings: Sequence[str] = ()) -> DataFrame:
    """One row per key of either table; a field is the newer one's unless that is empty, then the older one's."""
    full = lambda c, f: F.nullif(c[f], F.lit("")) if f in strings else c[f]
    return older.join(newer, older[key].eqNullSafe(newer[key]), "full_outer").select(
        F.coalesce(newer[key], older[key]).alias(key), *[F.coalesce(full(newer, f), full(older, f)).alias(f) for f in fields]
    )


def collapsed_rows(rows: DataFrame, aliases: DataFrame, key: str, fields: Sequence[str], alias: str = "alias", canon: str = "canon") -> DataFrame:
    """One row per canonical name: its own row's fields, empty ones filled from its aliases by smallest alias."""
    a = aliases.select(F.lower(alias).alias("_k"), F.col(canon).alias("_c")).where(F.col("_k").isNotNull()).distinct()
    named = rows.withColumn("_k", F.lower(key)).join(a, "_k", "left").withColumn("_canon", F.coalesce("_c", key))
    order = F.struct((F.col("_c").isNotNull()).alias("o"), F.col(key).alias("n"))
    return named.groupBy(F.col("_canon").alias(key)).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields])


def merged_edges(edges: DataFrame, aliases: DataFrame, alias: str = "alias", canon: str = "canon") -> DataFrame:
    """(a, b, w, members): directed edges after alias collapse: the greatest weight, never the sum, of those that fall together, the union
    of their members, and no self-loops."""
    m = aliases.select(F.col(alias).alias("_k"), F.col(canon).alias("_v"))
    to = lambda df, c: df.join(m.select(F.col("_k").alias(c), F.col("_v").alias("_n")), c, "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
    return (
        to(to(edges, "a"), "b").where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.max("w").alias("w"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"))
    )


def chains(aliases: DataFrame, alias: str = "alias", canon: str = "canon", rounds: int = 40) -> DataFrame:
    """Aliases of aliases pointed at the end of their chain, by doubling; a ring is left where doubling stops."""
    from ..runtime import cut

    cur = cut(aliases.select(F.col(alias).alias("k"), F.col(canon).alias("v")).where(F.col("k") != F.col("v")))
    for _ in range(rounds):
        nxt = cur.select(F.col("k").alias("v"), F.col("v").alias("w"))
        step = cut(cur.join(nxt, "v", "left").select("k", F.coalesce("w", "v").alias("v"), (F.col("w").isNotNull() & (F.col("w") != F.col("k"))).alias("moved")))
        cur = step.select("k", "v")
        if step.where("moved").isEmpty():
            break
    return cur.select(F.col("k").alias(alias), F.col("v").alias(canon))


def accumulated(new: DataFrame, old: DataFrame, alias: str = "alias", canon: str = "canon") -> DataFrame:
    """A new alias table with what the previous run knew: new rows win, old ones survive and follow merges made since."""
    ids = new.select(F.col(alias).alias("_x")).unionByName(new.select(F.col(canon).alias("_x"))).distinct()
    kept = old.join(ids, old[alias] == ids["_x"], "left_anti")
    return chains(new.select(alias, canon).unionByName(kept.select(alias, canon)), alias, canon)


def rewritten_list(ids: DataFrame, nodes: DataFrame, column: str = "repo", pos: str = "pos") -> DataFrame:
    """A list with each id as the node it means, in input order, of repeats the first."""
    got = resolved(ids.select(column, pos), column, nodes, "_n").withColumn(column, F.coalesce("_n", column))
    return got.groupBy(column).agg(F.min(pos).alias(pos))


def unknown(df: DataFrame, seen: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose id, without case, was not seen."""
    return df.join(seen.select(F.lower(key).alias("_k")).distinct(), F.lower(df[column]) == F.col("_k"), "left_anti")


def first_filled(sources: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value, source): of several tables the first that has the key."""
    whole = None
    for i, s in enumerate(sources):
        part = s.select(key, value, F.lit(i).alias("source"))
        whole = part if whole is None else whole.unionByName(part)
    best = whole.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(value, "source"), F.struct("source", value)).alias("r"))
    return best.select(key, F.col("r")[value].alias(value), F.col("r.source").alias("source"))


def name_matches(packages: DataFrame, nodes: DataFrame, package: str = "package", node: str = "node") -> DataFrame:
    """(package, node): the node whose bare name is the first variant of the package's that exactly one node has."""
    bare = nodes.select(F.lower(F.regexp_extract(node, "/(.*)$", 1)).alias("_name"), F.col(node).alias("_node")).where(F.col("_name") != "").distinct()
    sole = bare.groupBy("_name").agg(F.count("*").alias("n"), F.min("_node").alias("node")).where(F.col("n") == 1).select("_name", "node")
    tries = packages.select(package, F.posexplode(name_variants(F.col(package))).alias("_rank", "_name")).distinct()
    return tries.join(sole, "_name").groupBy(package).agg(F.min_by("node", "_rank").alias(node))


def corroborated(pairs: DataFrame, tags: DataFrame, version: str = "version", origin: str = "origin", tag: str = "tag") -> DataFrame:
    """pairs with `ok`: whether a tag of the origin encodes the version (one is the other or a dotted prefix of it).

    Of each tag only its candidates that begin with the version's first number can match, so origin and that number are the join key.
    """
    first = lambda c: F.substring_index(c, ".", 1)
    p = pairs.withColumn("_core", version_core(F.col(version))).withColumn("_f", first(F.col("_core")))
    c = tags.select(F.col(origin).alias("_o"), F.explode(version_candidates(F.col(tag))).alias("_c")).distinct().withColumn("_f", first(F.col("_c")))
    p = p.withColumn("_row", F.monotonically_increasing_id())
    hit = p.join(c, (p[origin] == c["_o"]) & (p["_f"] == c["_f"])).where(version_matches(F.col("_core"), F.col("_c"))).select("_row").distinct().withColumn("ok", F.lit(True))
    return p.join(hit, "_row", "left").drop("_row", "_core", "_f").withColumn("ok", F.coalesce("ok", F.lit(False)))


def first_n(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int | Column) -> DataFrame:
    """The first n rows of each key; n may depend on the row."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def quota(df: DataFrame, bucket: Column, order: Sequence[Column], total: int, part: float = 0.5) -> DataFrame:
    """The first `total` rows in order, no bucket with more than max(1, int(total * part)) of them: capped rows make room for later ones."""
    most = max(1, int(total * part))
    w = Window.partitionBy("_bucket").orderBy(*order)
    return df.withColumn("_bucket", F.coalesce(bucket, F.lit(""))).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).orderBy(*order).limit(total).drop("_bucket", "_rn")


def by_priority(df: DataFrame, key: Sequence[str], priority: Column) -> DataFrame:
    """Rows of the key's best (lowest) priority."""
    w = Window.partitionBy(*key)
    return df.withColumn("_p", priority).withColumn("_b", F.min("_p").over(w)).where(F.col("_p") == F.col("_b")).drop("_p", "_b")


def two_hops(first: DataFrame, second: DataFrame, key: str, via: str, order: Sequence[Column], cap: int) -> DataFrame:
    """first joined with second on via, after each key's rows of first are cut to the first `cap` in order."""
    return first_n(first, [key], order, cap).join(second, via)


def is_person(name: Column) -> Column:
    """No ghost, no bot, no path."""
    return (name != "ghost") & ~F.contains(name, F.lit("[bot]")) & ~F.contains(name, F.lit("/"))


def admitted(counts: DataFrame, is_node: Column, is_forge: Column, count: Column, least: int = 5) -> DataFrame:
    """With `state`: node (already one), admitted (a forge node with support), later (any other with support), or refused."""
    return counts.withColumn("state", F.when(is_node, "node").when(is_forge & (count >= least), "admitted").when(count >= least, "later").otherwise("refused"))


def row_of_either(dump: DataFrame, api: DataFrame, key: str, stars: str, fields: Sequence[str]) -> DataFrame:
    """The dump's row where it has stars, else the api's row, else none; whole rows, never field by field."""
    d = dump.where(F.col(stars).isNotNull()).select(key, *fields, F.lit("dump").alias("origin"))
    a = api.join(d.select(key), key, "left_anti").select(key, *fields, F.lit("api").alias("origin"))
    return d.unionByName(a)


def copied_hashes(files: DataFrame, repo: str = "repo", digest: str = "hash") -> DataFrame:
    """(hash, holders): content that more than one repository holds."""
    pairs = files.select(repo, digest).distinct()
    return pairs.groupBy(digest).agg(F.count("*").alias("holders")).where(F.col("holders") > 1)


def own_manifests(files: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """Files without nested ones that are copies; root files always stay."""
    copies = copied_hashes(files).select(digest)
    nested = F.contains(F.col(path), F.lit("/"))
    return files.where(~nested).unionByName(files.where(nested).join(copies, digest, "left_anti").select(*files.columns))


def upper_median(df: DataFrame, value: str, out: str = "median") -> DataFrame:
    """The value at place n // 2 of the sorted non-null values, counted from 0: of an even number the upper middle one.

    Found from counts per value, summed up over any number of tasks.
    """
    counts = cut(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c")))
    n = counts.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    upto = running_sum(counts, [], [F.col(value)], "_c", "_upto")
    return upto.where(F.col("_upto") > n // 2).agg(F.min(value).alias(out))
