"""Groups of similar sets from postings, without forming all pairs of a group.

Similarity is Jaccard over exact sets.  A posting says that set e, of n members,
is listed under a key, one of the rarest members that make up its prefix; two
similar enough sets share a key.  Three ideas keep the work down when thousands
of sets are alike:

* star rounds: each list names a leader per size block (first the one whose
  members are in the most sets, as those of an unchanged original are; the blocks
  of the next round straddle those of the last) and only leader-member pairs are
  verified; members that pass inherit the leader's group, so a set's answer is
  derived from that of a set like it;
* lists whose members are in one group already are skipped whole;
* what is left is joined in full, pairs from different groups only, under the
  length and positional filters.  Nothing is capped, so no group is missed.  Lists
  of band values say little about members: there the sets of a longer list meet only
  where they share one of their rarest members too, which similar sets can't avoid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partcast.llm.components import components
from partcast.llm.scratch import Scratch

PERCENT = 80
#: Lists of band values with more sets than this are split by members before their pairs are formed.
SHORT = 8


def similar(common: Column, n: Column, m: Column, percent: int) -> Column:
    """100 * intersection >= percent * union."""
    return common * (100 + percent) >= (n + m) * percent


def _fits(a: str, b: str, percent: int) -> Column:
    """Length filter, and the positional filter where both sides know what follows the key."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(F.col(f"{a}.left"), F.col(f"{b}.left")) + 1
    return ((F.least(n, m) * 100 >= F.greatest(n, m) * percent)
            & (most.isNull() | similar(most, n, m, percent)))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b), sets (e, members): those pairs whose sets are similar."""
    left = sets.select(F.col("e").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("e").alias("b"), F.col("members").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return (pairs.join(right, "b").join(left, "a")
            .where(similar(common, F.size("x"), F.size("y"), percent)).select("a", "b"))


def prefix_length(n: str, percent: int) -> str:
    """How many members a partner at the threshold can't all miss."""
    return f"({n} - floor(({n} * {percent} + 99) / 100) + 1)"


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """sets (e, members) -> (key, e, n, left, shared): the rarest members that make up each set's prefix.

    Members of one set only come first and need no posting; left is how many
    follow the key in the global order, shared in how many sets a member is on average.
    """
    tokens = sets.select(F.explode("members").alias("key"), "e", F.size("members").alias("n"))
    shared = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = tokens.join(shared, "key").selectExpr(
        "key", "e", "n", "row_number() over (partition by e order by df, key) as i", "count(1) over (partition by e) as s",
        "sum(df) over (partition by e) as meets")
    return (ranked.where(f"i <= {prefix_length('n', percent)} - (n - s)")
            .selectExpr("key", "e", "n", "int(s - i) as left", "meets / n as shared"))


def bounded(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """lists without the sets that no other can be similar to, left as the most that a partner can share beside the key.

    Members that only one set has can't be shared: copies with a change each, however many of one text there are,
    are told apart by that before any two of them meet.
    """
    tokens = sets.select(F.explode("members").alias("member"), "e")
    common = tokens.groupBy("member").agg(F.min("e").alias("lo"), F.max("e").alias("hi")).where("lo <> hi").select("member")
    most = tokens.join(common, "member").groupBy("e").agg(F.count(F.lit(1)).alias("s"))
    return lists.join(most, "e").where(f"100 * s >= {percent} * n").withColumn("left", F.expr("int(s - 1)")).drop("s")


def in_shared_lists(listed: DataFrame) -> DataFrame:
    """(key, e, ...): the rows whose key lists more than one set."""
    shared = listed.groupBy("key").agg(F.min("e").alias("lo"), F.max("e").alias("hi")).where("lo <> hi")
    return listed.join(shared.select("key"), "key")


def pairs_of_lists(now: DataFrame, percent: int) -> DataFrame:
    """now (key, e, n, left, label): (a, b) of all pairs in a list that pass the filters."""
    both = now.alias("m").join(now.alias("l"), "key").where("m.e < l.e")
    return both.where(F.col("m.label") != F.col("l.label")).where(_fits("m", "l", percent)).select(
        F.col("l.e").alias("a"), F.col("m.e").alias("b"))


def pairs_of_bands(now: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The same for lists of band values; no similar pair is left out.

    A short list is paired as it is.  In a long one, two sets meet under each of the rarest members that both have in
    their prefixes.  The smaller set is listed by the prefix for partners of its size or more, the larger one looks
    no further than the smallest set of the list makes necessary.
    """
    long = now.groupBy("key").agg(F.count(F.lit(1)).alias("_z"), F.min("n").alias("least")).where(f"_z > {SHORT}").select("key", "least")
    crowded = scratch.keep(now.join(long, "key").select("key", "e", "n", "label", "least"))
    rarest = postings(sets.join(crowded.select("e").distinct(), "e", "left_semi"), percent).select(
        F.col("key").alias("member"), "e", "left")
    needed = similar(F.col("left") + 1, F.col("n"), F.greatest("least", F.expr(f"n * {percent} div 100")), percent)
    asked = scratch.keep(crowded.join(rarest, "e").where(needed).drop("least"))
    index = asked.where(similar(F.col("left") + 1, F.col("n"), F.col("n"), percent))
    met = (asked.alias("m").join(index.alias("l"), ["key", "member"]).where("l.n < m.n OR (l.n = m.n AND l.e < m.e)")
           .where(F.col("m.label") != F.col("l.label")).where(_fits("m", "l", percent))
           .select(F.col("l.e").alias("a"), F.col("m.e").alias("b")))
    return pairs_of_lists(now.join(long, "key", "left_anti"), percent).unionByName(
        met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))


def groups(candidates: DataFrame, fetch: Callable[[DataFrame], DataFrame], scratch: Scratch,
           percent: int = PERCENT, star_rounds: int = 3, lists: DataFrame | None = None) -> DataFrame:
    """candidates (e) -> (e, label), for sets that are similar to another one.

    Sets meet in the lists of their prefix or, where a kept table lists (key, e, n, left, shared) is given, in those;
    that table is removed.

    label is the smallest e of the group.  fetch gives (e, members) for the sets
    of a one-column table e.  Frequencies are those among the candidates: any
    global order is right, and this one leaves the shortest lists.
    """
    wanted = scratch.keep(candidates)
    sets = scratch.keep(fetch(wanted))
    scratch.drop(wanted)
    bands = lists is not None
    if not bands:
        lists = scratch.keep(in_shared_lists(scratch.keep(postings(sets, percent))))
    else:
        whole, lists = lists, scratch.keep(bounded(lists, sets, percent))
        scratch.drop(whole)
    label = None
    for r in range(star_rounds + 1):
        now, mine = lists.withColumn("label", F.col("e")), None
        if label is not None:
            now = (lists.join(label.withColumnRenamed("node", "e"), "e", "left")
                   .withColumn("label", F.coalesce("label", "e")))
            mixed = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
            now = mine = scratch.keep(now.join(mixed.select("key"), "key"))
        if r < star_rounds:
            now = now.withColumn("block", F.floor(
                F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + F.lit(r % 2 / 2)))
            leader = (now.groupBy("key", "block")
                      .agg(F.min(F.struct(-F.col("shared") if r < 2 else F.lit(0), F.xxhash64("e", F.lit(r)), "e", "n", "left", "label")).alias("s"))
                      .select("key", "block", "s.e", "s.n", "s.left", "s.label"))
            both = now.alias("m").join(leader.alias("l"), ["key", "block"])
            pairs = (both.where(F.col("m.label") != F.col("l.label")).where(_fits("m", "l", percent))
                     .select(F.col("l.e").alias("a"), F.col("m.e").alias("b")))
        else:
            pairs = pairs_of_bands(now, sets, scratch, percent) if bands else pairs_of_lists(now, percent)
        found = scratch.keep(verify(pairs.distinct(), sets, percent))
        if mine is not None:
            scratch.drop(mine)
        if r and found.isEmpty():
            continue
        # the last round's groups are stars already: they and the new pairs reach what all pairs so far do
        edges = found if label is None else label.toDF("a", "b").unionByName(found)
        label = components(edges, scratch)
    return label.select(F.col("node").alias("e"), "label")
