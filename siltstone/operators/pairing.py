"""Pairs of evidence from different documents of one domain, in the order of a greedy builder, without walking the list.

The builder takes the first unused candidate and the first unused one of another document, again and again. What is passed over meanwhile always belongs to one document, so it works like a queue of that document's
candidates: equal documents join the queue, others leave with its head. Between two moments with an empty queue lies a stretch whose queue document is that of its first candidate. Where a stretch that begins at a
candidate would end follows from its own document's places alone (a next-greater search among them); which candidates begin one follows inside blocks of places, and by pointer doubling over the few places where
a block can be entered; and in a stretch the n-th candidate of the queue's document goes with the n-th of the others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, sums: int = 256) -> DataFrame:
    """rows with their place (from 1) among those of the same keys. Places are counted in slices of each group, so that no task holds a whole one: a slice is a range of the order."""
    ranged = written(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()), f"{name}_ranged")
    part = F.shiftright("_at", 33)
    ranged = ranged.withColumn("_part", part)
    size = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    size = size.select("_part", *keys, "_first", before.alias("_before"))  # a row for each task and group that meet
    return ranged.join(F.broadcast(size), ["_part", *keys]).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_at", "_part", "_first", "_before")


def stretches(places: DataFrame) -> DataFrame:
    """(domain, doc_id, place, till): for each candidate the last place of the stretch that would begin with it, or null if its queue never empties.

    places(domain, doc_id, place). With p the place and j the number of a candidate among its document's, v = p - 2 j; the queue that begins at j empties before the next place whose v is at least as large. A document's
    candidates are one bounded group."""
    own = places.withColumn("j", F.row_number().over(W.partitionBy("domain", "doc_id").orderBy("place"))).withColumn("v", F.col("place") - 2 * F.col("j"))
    lists = own.groupBy("domain", "doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "j", "v"))).alias("all"), F.count("*").alias("n"))
    # From the last to the first: a stack of those that no later one exceeds; the first on it with v at least as large is the answer.
    kind = "array<struct<place:bigint,j:int,v:bigint>>"
    none = F.struct(F.array().cast(kind).alias("stack"), F.array().cast("array<struct<place:bigint,later:int>>").alias("found"))

    def step(s, x):
        left = F.filter(s.stack, lambda y: y.v >= x.v)
        first = F.get(left, F.lit(0)).getField("j")
        return F.struct(F.concat(F.array(F.struct(x.place.alias("place"), x.j.alias("j"), x.v.alias("v"))).cast(kind), left).alias("stack"), F.concat(s.found, F.array(F.struct(x.place.alias("place"), first.alias("later")))).alias("found"))

    made = lists.select("domain", "doc_id", "n", F.explode(F.aggregate(F.reverse("all"), none, step, lambda s: s.found)).alias("x")).select("domain", "doc_id", "n", "x.place", "x.later")
    size = places.groupBy("domain").agg(F.max("place").alias("last"))
    rows = made.join(own.select("domain", "doc_id", "place", "j"), ["domain", "doc_id", "place"]).join(size, "domain")
    # With m of the document's candidates in the stretch, it has as many others.
    many = F.coalesce(F.col("later"), F.col("n") + 1) - F.col("j")
    till = F.col("place") + 2 * many - 1
    return rows.select("domain", "doc_id", "place", F.when(till <= F.col("last"), till).alias("till"))


def beginnings(ends: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(domain, place): where stretches really begin: place 1, and after each stretch. ends(domain, place, till); a next place that has no row ends the way. Reach doubles each round, so the rounds are about the logarithm of the longest domain; each is a written table."""
    jump = written(ends.where("till is not null").select("domain", "place", (F.col("till") + 1).alias("next")).join(ends.select("domain", F.col("place").alias("next")), ["domain", "next"]), "jumps")
    reached = written(ends.where("place = 1").select("domain", "place"), "starts")
    for _ in range(max_rounds):
        more = reached.join(jump, ["domain", "place"]).select("domain", F.col("next").alias("place"))
        wider = written(reached.unionByName(more).distinct(), "starts")
        if wider.count() == reached.count():
            return reached
        reached = wider
        far = jump.select("domain", F.col("next").alias("place"), F.col("place").alias("from")).join(jump, ["domain", "place"])
        jump = written(far.select("domain", F.col("from").alias("place"), "next"), "jumps")
    raise RuntimeError(f"no end after {max_rounds} rounds")


#: Places of a block.
BLOCK = 1 << 16


def _in_blocks(rows: DataFrame, block: int, made: Callable[[np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]], name: str) -> DataFrame:
    """(domain, place, name): what made(places, nexts, doors, end) gives for each block of rows(domain, place, next, door); next is 0 where there is none. A block is a bounded group."""
    kind = dict(rows.dtypes)["domain"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        places = table["place"].to_numpy()
        at, out = made(places, table["next"].to_numpy(), table["door"].to_numpy(), (int(places[0]) // block + 1) * block)
        return pa.table({"domain": table["domain"].take(pa.array(np.zeros(len(at), np.int64))), "place": pa.array(at), name: pa.array(out)})

    by = rows.withColumn("_block", F.expr(f"place div {block}"))
    return by.groupBy("domain", "_block").applyInArrow(lambda t: run(t.drop_columns(["_block"])), f"domain {kind}, place long, {name} long")


def _exits(places: np.ndarray, nexts: np.ndarray, doors: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each place's first place past its block on the way of its nexts, 0 if the way ends before."""
    n = len(places)
    to = np.append(np.where((nexts > 0) & (nexts < end), nexts - places[0], n), n)  # places of a block follow on each other
    last = np.where(to[:n] < n, 0, nexts)
    out = np.append(last, 0)
    while (to[:n] < n).any():  # each round doubles the steps
        out = np.where(to < n, out[to], out)
        to = to[to]
    return places, out[:n]


def _passed(places: np.ndarray, nexts: np.ndarray, doors: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that the way from the block's door passes."""
    found, at = [], int(places[np.argmax(doors)]) if doors.any() else 0
    while at and at < end:
        found.append(at)
        at = int(nexts[at - places[0]])
    return np.array(found, np.int64), np.ones(len(found), np.int64)


def starts_of(ends: DataFrame, block: int = BLOCK) -> DataFrame:
    """As beginnings. Each block of places finds for itself where a way that comes in goes out. The ways meet fast, so doors, the places where one can come in, are few, and only these are followed by doubling;
    from the one door of a block that is really passed the block finds its own beginnings."""
    last = ends.groupBy("domain").agg(F.max("place").alias("last"))
    there = ends.join(F.broadcast(last), "domain")  # a row a domain
    rows = there.select("domain", "place", F.when(F.col("till") < F.col("last"), F.col("till") + 1).otherwise(0).alias("next"), F.lit(False).alias("door"))
    out = written(_in_blocks(rows, block, _exits, "out"), "exits")
    doors = out.where("out > 0").select("domain", F.col("out").alias("place")).unionByName(out.where("place = 1").select("domain", "place")).distinct()
    ways = written(out.join(doors, ["domain", "place"]).select("domain", "place", F.when(F.col("out") > 0, F.col("out") - 1).alias("till")), "doors")
    passed = beginnings(ways)  # at most one a block
    rows = rows.drop("door").join(F.broadcast(passed.withColumn("door", F.lit(True))), ["domain", "place"], "left").withColumn("door", F.coalesce("door", F.lit(False)))
    return _in_blocks(rows, block, _passed, "there").select("domain", "place")


def cross_document_pairs(candidates: DataFrame) -> DataFrame:
    """(domain, first_key, second_key, pair_no): candidates(domain, doc_id, key) of different documents, paired within their domain as by the builder, in key order; pair_no counts from 1 by the first's place.

    Keys are distinct within a domain; rows with a null take no part. What stays in the queue at the end has no pair."""
    rows = candidates.select("domain", "doc_id", "key").where("domain is not null and doc_id is not null and key is not null")
    places = written(numbered(rows, ["domain"], ["key"], "place"), "places")
    ends = written(stretches(places), "stretches")
    starts = written(starts_of(ends), "starts").join(ends, ["domain", "place"]).select("domain", F.col("place").alias("begin"), F.col("doc_id").alias("queue"))
    # The stretch of a candidate is the last one that begins at or before it: each stretch names its places up to the next beginning.
    w = W.partitionBy("domain").orderBy("begin")
    starts = starts.withColumn("next", F.lead("begin").over(w)).join(places.groupBy("domain").agg(F.max("place").alias("last")), "domain")
    inside = starts.select("domain", "begin", "queue", F.explode(F.sequence("begin", F.coalesce(F.col("next") - 1, "last"))).alias("place"))
    rows = places.join(inside, ["domain", "place"]).withColumn("first", F.col("doc_id") == F.col("queue"))
    turn = F.row_number().over(W.partitionBy("domain", "begin", "first").orderBy("place"))
    rows = rows.withColumn("turn", turn)
    side = lambda first, name: rows.where(F.col("first") == first).select("domain", "begin", "turn", F.col("key").alias(name), F.col("place").alias(f"{name}_place"))
    pairs = side(True, "first_key").join(side(False, "second_key"), ["domain", "begin", "turn"])
    return numbered(pairs.select("domain", "first_key", "second_key", "first_key_place"), ["domain"], ["first_key_place"], "pair_no").drop("first_key_place")
