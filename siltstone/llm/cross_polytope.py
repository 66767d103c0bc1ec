"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by a fast pseudo-random rotation (three rounds of random signs and a Hadamard transform); its hash is
the nearest of the 2d corners of the cross-polytope, that is the largest coordinate and its sign. ``hashes`` rotations
make a code. In each table a vector lives in the bucket of its own code and visits the ``probes - 1`` next likely ones; a pair
meets where one lives and the other lives or visits. Every pair that meets is verified by cosine in double precision.

A pair is counted in the first bucket where it meets, which both sides' codes tell without looking anywhere else; so links
are counted inside the buckets and no pair ever leaves one, only a count for each member and a spanning forest. Buckets
are cut into slices that meet two by two, so no task gets more than two slices. Equal vectors are one entry with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, checked_broadcast
from .components import connected_components
from .permutation_index import sound, vectors_of

#: hashes -> tables and probes with which a pair of cosine 0.93 is missed once in 10,000 times or less (64 dimensions).
TABLES = {1: (5, 3), 2: (6, 8), 3: (8, 16)}
#: Corners of one hash that probes are made of, by hashes.
CORNERS = {1: 6, 2: 5, 3: 4}
#: Entries of a label up to which so many hashes do: buckets then hold some thousand entries at most, unless they are alike.
ENOUGH = {1: 1 << 18, 2: 1 << 25}
#: Rows of one block of a cosine matrix.
BLOCK = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row, in log d steps of sums and differences."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def codes(vectors: np.ndarray, hashes: int, tables: int, probes: int, seed: int = 12) -> np.ndarray:
    """For each row and table the most likely codes, its own first: an array of rows x tables x probes."""
    rows, dims = vectors.shape
    wide = 1 << max(0, (dims - 1).bit_length())
    base = np.zeros((rows, wide))
    base[:, :dims] = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    random = np.random.Generator(np.random.PCG64(seed))
    signs = random.integers(0, 2, (tables, hashes, 3, wide)) * 2.0 - 1.0
    many = min(CORNERS[hashes], 2 * wide)
    out = np.empty((rows, tables, min(probes, many**hashes)), np.int32)
    for t in range(tables):
        code, loss = np.zeros((rows, 1), np.int64), np.zeros((rows, 1))
        for k in range(hashes):
            x = base
            for s in signs[t, k]:
                x = hadamard(x * s) / np.sqrt(wide)
            both = np.concatenate([x, -x], 1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :many]
            near = np.take_along_axis(both, top, 1)
            code = (code[:, :, None] * (2 * wide) + top[:, None, :]).reshape(rows, -1)
            loss = (loss[:, :, None] + ((near[:, :1] - near) ** 2)[:, None, :]).reshape(rows, -1)
        best = np.argsort(loss, axis=1, kind="stable")[:, : out.shape[2]]
        out[:, t] = np.take_along_axis(code, best, 1)
    return out


def first_meeting(a: np.ndarray, b: np.ndarray, table: int, code: int) -> np.ndarray:
    """Whether pairs of entries, given by their codes (pairs x tables x probes), meet for the first time in this bucket."""
    first = np.ones(len(a), bool)
    for t in range(table + 1):
        a_sees, b_sees = (a[:, t] == b[:, t, :1]).any(1), (b[:, t] == a[:, t, :1]).any(1)
        if t < table:
            first &= ~(a_sees | b_sees)
        else:  # pairs that see each other meet in two buckets of the table, unless these are the same
            first &= ~(a_sees & b_sees) | (np.minimum(a[:, t, 0], b[:, t, 0]) == code)
    return first


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the ends of the pairs in a forest of least members, in place."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def bucket_links(unit: np.ndarray, code: np.ndarray, weight: np.ndarray, lives: np.ndarray, side: np.ndarray | None, table: int, bucket: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member of a bucket (the weights of its partners, summed) and its root in the bucket's forest.

    side: None for a whole bucket or a slice with itself; else 0 or 1, and only pairs of different sides are looked at.
    """
    links, root = np.zeros(len(unit), np.int64), np.arange(len(unit))
    # Rows that live here against all: a pair of two inhabitants is taken at the lower index.
    home, order = np.flatnonzero(lives), np.arange(len(unit))
    for at in range(0, len(home), BLOCK):
        rows = home[at : at + BLOCK]
        near = unit[rows] @ unit.T >= least
        near &= ~lives[None, :] | (order[None, :] > rows[:, None])
        if side is not None:
            near &= side[rows][:, None] != side[None, :]
        i, b = np.nonzero(near)
        a = rows[i]
        for k in range(0, len(a), 1 << 17):
            x, y = a[k : k + (1 << 17)], b[k : k + (1 << 17)]
            new = first_meeting(code[x], code[y], table, bucket)
            x, y = x[new], y[new]
            links += np.bincount(x, weight[y], len(unit)).astype(np.int64) + np.bincount(y, weight[x], len(unit)).astype(np.int64)
            join_roots(root, x, y)
    return links, root


def near_vectors(vectors: DataFrame, least: float = 0.93, hashes: int | None = None, tables: int | None = None, probes: int | None = None, slice_rows: int = 4096) -> DataFrame:
    """Links between embeddings(vec_id, embedding, label) of one label with a cosine of ``least`` or more, in double precision.

    Returns one row for each row with a vec_id: vec_id, n_links (other vectors linked directly, copies counted), component_id (the smallest vec_id
    that links reach, itself included) and kept (vec_id = component_id). hashes: rotations of a code; by default 1 for up
    to 2^18 different vectors in the largest label, 2 up to 2^25, then 3; tables and probes follow from it (TABLES). Vectors that are null, zero or hold null or non-finite
    components, and those with a null label, link with nothing; nor do vectors of different lengths. Rows with a null
    vec_id are left out; rows repeated under one vec_id are vectors of their own, a row each. Other columns are ignored; an empty table gives no
    rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "polytopes")
    takes = F.coalesce(sound("embedding") & F.col("label").isNotNull(), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where("vec_id IS NOT NULL")
    keys = rows.withColumn("k1", F.when(takes, F.xxhash64("label", "embedding"))).withColumn("k2", F.when(takes, F.xxhash64(F.lit(1), "embedding", "label")))
    entries = keys.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
    entries = scratch.save(entries, "entries")
    most = entries.groupBy("label").count().agg(F.max("count")).first()[0]
    plain = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if most is None:
        return plain
    hashes = hashes or next((k for k, n in ENOUGH.items() if most <= n), 3)
    tables, probes = tables or TABLES[hashes][0], probes or TABLES[hashes][1]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).value_lengths().to_numpy()
            made = np.zeros((len(batch), tables * probes), np.int32)
            for d in np.unique(size):
                some = np.flatnonzero(size == d)
                flat = codes(vectors_of(batch.column(2).take(pa.array(some))), hashes, tables, probes)
                # Short vectors have fewer codes than probes: the rest repeat the own code and are dropped when posted.
                full = np.concatenate([flat, np.repeat(flat[:, :, :1], probes - flat.shape[2], 2)], 2)
                made[some] = full.reshape(len(some), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * (tables * probes)), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["entry", "label", "embedding", "copies", "codes"])

    kind = entries.schema["embedding"].dataType.simpleString()
    # Entries are told apart and ordered by their least vec_id, so the least entry of a component names it.
    entry = "struct<least:long,k1:long,k2:long>"
    narrow = entries.select(F.struct("least", "k1", "k2").alias("entry"), "label", "embedding", "copies")
    schema = f"entry {entry}, label {entries.schema['label'].dataType.simpleString()}, embedding {kind}, copies long, codes array<int>"
    coded = scratch.save(narrow.mapInArrow(hashed, schema).withColumn("dims", F.size("embedding")), "codes")

    posted = coded.select("*", F.posexplode("codes").alias("place", "code")).withColumn("tab", F.floor(F.col("place") / probes).cast("int"))
    posted = posted.withColumn("lives", F.col("place") % probes == 0).where(F.col("lives") | (F.col("code") != F.element_at("codes", F.col("tab") * probes + 1)))
    bucket = ["label", "dims", "tab", "code"]
    sizes = posted.groupBy(*bucket).agg(F.count("*").alias("members"), F.count_if("lives").alias("homes")).where("homes > 0 AND members > 1")
    sizes = scratch.save(sizes.select(*bucket, F.ceil(F.col("members") / slice_rows).cast("int").alias("slices")), "buckets")

    # A member of a bucket with s slices goes to the s meetings of its own slice.
    members = posted.join(checked_broadcast(sizes, 40), bucket).withColumn("own", F.pmod(F.xxhash64("entry"), F.col("slices")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    members = members.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", F.when(F.col("i") < F.col("j"), (F.col("own") == F.col("j")).cast("int")))
    meeting = [*bucket, "i", "j"]
    members = members.select(F.xxhash64(*meeting).alias("meet"), "tab", "code", "entry", "copies", "lives", "side", "embedding", "codes")
    members = members.repartition("meet").sortWithinPartitions("meet")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by meeting; one meeting at a time is put together."""
        held: list[pa.RecordBatch] = []

        def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            meet = t.column(0).to_numpy()
            cut = np.append(np.flatnonzero(np.append(True, meet[1:] != meet[:-1])), len(meet))
            tab, code, weight = (t.column(c).to_numpy() for c in (1, 2, 4))
            lives, side = t.column(5).to_numpy(zero_copy_only=False), t.column(6).fill_null(-1).to_numpy()
            seen = t.column(8).flatten().to_numpy().reshape(len(meet), tables, probes)
            links, root = np.zeros(len(meet), np.int64), np.arange(len(meet))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                unit = vectors_of(t.column(7).slice(a, b - a))
                unit /= np.linalg.norm(unit, axis=1)[:, None]
                links[a:b], r = bucket_links(unit, seen[a:b], weight[a:b], lives[a:b], side[a:b] if side[a] >= 0 else None, tab[a], code[a], least)
                root[a:b] = r + a
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([t.column(3).take(pa.array(some)), t.column(3).take(pa.array(root[some])), pa.array(links[some])], ["entry", "root", "links"])

        def split(parts: list[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
            """All but the last meeting, and the last one, which may go on."""
            last = parts[-1].column(0)[len(parts[-1]) - 1].as_py()
            done, rest = [], []
            for p in parts:
                k = int(np.searchsorted(p.column(0).to_numpy(), last))
                done += [p.slice(0, k)] if k else []
                rest += [p.slice(k)] if k < len(p) else []
            return done, rest

        for batch in batches:
            if not len(batch):
                continue
            done, held = split([*held, batch])
            if done:
                yield from whole(done)
        if held:
            yield from whole(held)

    found = scratch.save(members.mapInArrow(verify, f"entry {entry}, root {entry}, links long"), "links")
    comps = connected_components(found.select(F.col("entry").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("entry").agg(F.sum("links").alias("links")).join(comps, F.col("entry") == F.col("node"), "left")
    links = links.select("entry.k1", "entry.k2", "links", F.coalesce("root", "entry").getField("least").alias("component_id"))
    counted = entries.select("k1", "k2", "least", "copies").join(links, ["k1", "k2"], "left")
    counted = counted.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")).where("n_links > 0")
    result = scratch.save(counted, "result")
    out = keys.select("vec_id", "k1", "k2").join(checked_broadcast(result, 40), ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
