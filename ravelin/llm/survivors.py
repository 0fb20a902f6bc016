"""The best representative of each group of duplicate records, by dominance layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def follow(moves: DataFrame, src: str = "src", dst: str = "dst", max_doublings: int = 40) -> DataFrame:
    """(src, dst): where each name ends up when followed from move to move.

    Pointer doubling: a chain of n moves takes log2(n) joins. moves has one row per src; a row with src = dst or a null
    is no move. A name that runs into a ring ends at the ring's smallest name.
    """
    jump = cut(
        moves.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(
            F.col(src).alias("s"), F.col(dst).alias("d"), F.least(src, dst).alias("low")
        )
    )
    for _ in range(max_doublings):
        nxt = jump.select(F.col("s").alias("s2"), F.col("d").alias("d2"), F.col("low").alias("low2"))
        new = cut(
            jump.join(nxt, jump["d"] == nxt["s2"], "left").select(
                "s", F.coalesce("d2", "d").alias("d"), F.least("low", F.coalesce("low2", "low")).alias("low"), F.col("d2").isNotNull().alias("moved")
            )
        )
        moved = new.where("moved")
        # only names on or before a ring still move once every chain has been passed; their lows then no longer sink
        state = moved.agg(F.count("*").alias("n"), F.sum(F.xxhash64("s", "low").cast("decimal(38,0)")).alias("h")).first()
        jump = new.select("s", "d", "low")
        if state["n"] == 0 or tuple(state) == locals().get("before"):
            break
        before = tuple(state)
    ring = jump.join(jump.select(F.col("s").alias("_x")), F.col("d") == F.col("_x"), "left")
    # d of a name that reaches a ring lies on the ring after 2^k moves; from there the low is the ring's own
    on_ring = ring.where(F.col("_x").isNotNull()).select("s", F.col("d").alias("_p"))
    lows = jump.select(F.col("s").alias("_p"), F.col("low").alias("_low"))
    closed = on_ring.join(lows, "_p").select(F.col("s").alias(src), F.col("_low").alias(dst))
    return ring.where(F.col("_x").isNull()).select(F.col("s").alias(src), F.col("d").alias(dst)).unionByName(closed)


def survivors(
    df: DataFrame,
    group: str,
    fields: dict[str, tuple[Column, Column]],
    recency: Sequence[Column],
    trust: Column | None = None,
    compare: Sequence[str] | None = None,
) -> DataFrame:
    """(group, fields..., layers): one surviving record per group.

    fields: output name to (value, quality): a value counts where quality > 0, and more quality is better.
    A record dominates another of its group if it is at least as good in the quality of every compared field (all of them unless
    named), in recency and in trust, and better in one. Layer 1 is what nothing dominates; any other record's layer is one
    more than the deepest of those that dominate it. A field is taken from the first layer that has it, within a layer
    by the lexicographic policy quality, recency, trust; so nulls are filled from successive layers.

    Of records with equal qualities and trust the most recent dominates the others, so one per (group, qualities, trust) is
    kept by a combining maximum, and layers are those of the kept: a group of any size costs as many rows as it has
    quality patterns, whose number does not grow with the data when qualities and trust are small scales. Only
    those are gathered and layered, inside the JVM.

    recency must be a total order for a defined result (end it with an id); nulls in it are the oldest. Cases: a null group is no group;
    a field without a usable value in the group is null; repeated rows change nothing; an empty table gives no rows.
    """
    names = list(fields)
    q = [f"_q{i}" for i in range(len(names))]
    v = [f"_v{i}" for i in range(len(names))]
    seen = [f"_q{names.index(n)}" for n in (compare if compare is not None else names)]
    pick = df.where(F.col(group).isNotNull()).select(
        F.col(group),
        *[F.when(fields[n][1] > 0, fields[n][0]).alias(x) for n, x in zip(names, v)],
        *[F.coalesce(F.greatest(fields[n][1], F.lit(0)), F.lit(0)).cast("int").alias(x) for n, x in zip(names, q)],
        F.coalesce(trust if trust is not None else F.lit(0), F.lit(0)).cast("int").alias("_t"),
        F.struct(*recency).alias("_r"),
    )
    kept = pick.groupBy(group, *q, "_t").agg(F.max_by(F.struct(*v, "_r"), "_r").alias("_b"))
    rows = kept.groupBy(group).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_b._r").alias("_r"), "_t", *q, *[F.col(f"_b.{x}").alias(x) for x in v])), asc=False).alias("_c")
    )

    def dominates(x: Column, y: Column) -> Column:
        no_worse, better = x["_t"] >= y["_t"], x["_t"] > y["_t"]
        for c in [*seen, "_r"]:
            no_worse, better = no_worse & (x[c] >= y[c]), better | (x[c] > y[c])
        return no_worse & better

    def layered(done: Column, y: Column) -> Column:
        above = F.array_max(F.transform(F.filter(done, lambda x: dominates(x["y"], y)), lambda x: x["n"]))
        return F.concat(done, F.array(F.struct((F.coalesce(above, F.lit(0)) + 1).alias("n"), y.alias("y"))))

    # the most recent come first, so whatever dominates a record is layered before it
    none = F.filter(F.transform("_c", lambda y: F.struct(F.lit(1).alias("n"), y.alias("y"))), lambda x: F.lit(False))
    rows = rows.select(group, F.aggregate("_c", none, layered).alias("_l"))

    def best(i: int) -> Column:
        has = F.filter("_l", lambda x: x["y"][q[i]] > 0)
        return F.array_max(
            F.transform(has, lambda x: F.struct((-x["n"]).alias("n"), x["y"][q[i]].alias("q"), x["y"]["_r"].alias("r"), x["y"]["_t"].alias("t"), x["y"][v[i]].alias("v")))
        )["v"]

    return rows.select(group, *[best(i).alias(n) for i, n in enumerate(names)], F.array_max(F.transform("_l", lambda x: x["n"])).alias("layers"))


#: Words and signs that stand for a missing title, compared without case and outer blanks.
PLACEHOLDERS = ("untitled", "null", "none", "(none)", "n/a", "na", "nan", "nil", "tbd", "todo", "unknown", "undefined", "no title", "(untitled)", "(null)", "placeholder", "?", "??", "???", "-", "--", "---", "_", ".", "..", "...")

BLANK = r"[\s\x00-\x20\x85\xa0  -     　]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def read_slug(c: Column) -> Column:
    """The lower slug of a spelling: outer blanks, case, a leading https://git.example/, closing slashes and a then closing .git go."""
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"^https://git\.example/", ""), r"/+$", "")
    return F.nullif(F.regexp_replace(s, r"\.git$", ""), F.lit(""))


def current_names(pages: DataFrame) -> DataFrame:
    """(repo, current_name): lower slugs that the latest ok page renames, with the end of the chain of full_names."""
    low = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    move = (
        pages.where((F.col("status") == "ok") & low("repo").isNotNull())
        .select(low("repo").alias("repo"), low("full_name").alias("full"), "fetched_at")
        .groupBy("repo")
        .agg(F.max_by("full", F.struct("fetched_at", "full")).alias("full"))
    )
    return follow(move, "repo", "full").withColumnRenamed("full", "current_name")


def surviving_repositories(records: DataFrame, pages: DataFrame) -> DataFrame:
    """(current_name, title, stargazers, records): one row per repository with two or more records (distinct rec_id) that has both.

    Quality of a title: 1 if it says something; of a count: 2 if proper, 1 if it is the cut-off 10000.
    Cases: a null rec_id is no record; of one rec_id the latest row holds; null times are the oldest; a spelling that reads as nothing is dropped.
    """
    one = records.where(F.col("rec_id").isNotNull()).groupBy("rec_id").agg(
        F.max_by(F.struct("repo", "title", "stargazers", "fetched_at"), F.struct("fetched_at", "repo", "title", "stargazers")).alias("r")
    )
    one = one.select("rec_id", read_slug(F.col("r.repo")).alias("slug"), strip(F.col("r.title")).alias("title"), F.col("r.stargazers").alias("stars"), F.col("r.fetched_at").alias("at")).where(F.col("slug").isNotNull())
    now = current_names(pages)
    named = one.join(now, one["slug"] == now["repo"], "left").select("rec_id", "slug", "title", "stars", "at", F.coalesce("current_name", "slug").alias("current_name"))
    low = F.lower("title")
    says = F.col("title").isNotNull() & (low != "") & ~low.isin(*PLACEHOLDERS) & ~low.rlike(r"^[\p{P}\p{S}]+$") & (low != F.element_at(F.split("slug", "/"), -1))
    stars = F.col("stars")
    best = survivors(
        named,
        "current_name",
        {"title": (F.col("title"), F.when(says, 1).otherwise(0)), "stargazers": (stars, F.when(stars.isNull() | (stars < 0), 0).when(stars == 10000, 1).otherwise(2))},
        [F.col("at"), F.col("rec_id")],
    )
    many = named.groupBy("current_name").agg(F.count("*").alias("records")).where(F.col("records") > 1)
    return best.join(many, "current_name").where(F.col("title").isNotNull() & F.col("stargazers").isNotNull()).select("current_name", "title", "stargazers", "records", "layers")
