"""Near copies among embeddings by lattice hashing.

Each table projects a unit vector to eight dimensions with a random orthonormal
projection and decodes the result to the nearest point of the E8 lattice; the
vector is listed under that cell and under the nearest neighbouring cells, of
the 240 around it.  Vectors that share a list are compared in double precision,
so nothing below the threshold is linked.  Equal vectors are one from the
start, with a count.

Lists are split into blocks of a bounded number of rows and each pair of blocks
is compared in a task of its own, as a matrix product: links are counted there,
never written out.  A pair that shares several lists counts in the first one
only, which each row can tell, as it carries its keys.

Defined results: vectors that are null, empty or zero, or hold null or
non-finite components, link with nothing and are their own component, as are
vectors of another length to each other; repeated rows link with one another; a
null id counts as absent when the smallest id is taken.  Other columns are not
looked at.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partcast.llm import words as W
from partcast.llm.components import components
from partcast.llm.scratch import Scratch

COSINE = 0.95
TABLES, PROBES, SCALE, BLOCK = 6, 2, 1.4, 512
SEED = 8

#: The 240 shortest vectors of E8: two entries of one, or all of one half with an even number of minus signs.
_SHORT = np.array(
    [[s * (i == a) + t * (i == b) for i in range(8)] for a, b in itertools.combinations(range(8), 2)
     for s in (1, -1) for t in (1, -1)]
    + [[x / 2 for x in signs] for signs in itertools.product((1, -1), repeat=8) if signs.count(-1) % 2 == 0], float)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the even points and those shifted by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def projections(length: int, tables: int) -> np.ndarray:
    """tables x length x 8, scaled so that a unit vector keeps its length on average."""
    rng = np.random.default_rng([SEED, length])
    out = np.zeros((tables, length, 8))
    for t in range(tables):
        q = np.linalg.qr(rng.standard_normal((length, min(length, 8))))[0]
        out[t, :, : q.shape[1]] = q * np.sqrt(length / 8)
    return out


def cells(unit: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """Keys (n, tables * (1 + probes)) of each vector's own and neighbouring cells."""
    n, length = unit.shape
    out = np.empty((n, tables, 1 + probes), np.uint64)
    # rows of projections have norm sqrt(8 / length) of the vector's on average; undone by the factor above
    for t, p in enumerate(projections(length, tables)):
        x = unit @ p * scale
        own = nearest(x)
        order = np.argsort(-((x - own) @ _SHORT.T), axis=1, kind="stable")[:, :probes]
        for j in range(1 + probes):
            point = own if not j else own + _SHORT[order[:, j - 1]]
            acc = np.full(n, (t + 1) * 1_000_003 + length, np.uint64)
            for c in (2 * point).astype(np.int64).view(np.uint64).T:
                acc = W.mix(acc * np.uint64(0x9E3779B97F4A7C15) + c)
            out[:, t, j] = acc
    return out.reshape(n, -1)


def _listed(batches, tables: int, probes: int, scale: float):
    """(e, copies, v, keys) for each distinct vector."""
    for batch in batches:
        column = batch.column("v")
        flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.diff(column.offsets.to_numpy())
        begin = np.concatenate([[0], np.cumsum(at)])
        keys = [None] * len(at)
        for length in np.unique(at):
            rows = np.flatnonzero(at == length)
            v = flat[begin[rows][:, None] + np.arange(length)]
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            for r, k in zip(rows, cells(v, tables, probes, scale)):
                keys[r] = np.unique(k)
        yield pa.RecordBatch.from_arrays(
            [batch.column("e"), batch.column("copies"), column,
             W.list_column(W.signed(np.concatenate(keys)) if keys else np.zeros(0, np.int64), [len(k) for k in keys])],
            names=["e", "copies", "v", "keys"])


def _compare(key: tuple, rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links within one pair of blocks of one list: (e, links, root)."""
    name, one, other = key
    parts = []
    for length, same in rows.groupby(rows["v"].map(len)):
        v = np.stack(same["v"].to_numpy()).astype(float)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        block = same["block"].to_numpy()
        hit = v @ v.T >= cosine
        np.fill_diagonal(hit, False)
        if one != other:
            hit &= block[:, None] != block[None, :]
        i, j = np.nonzero(np.triu(hit))
        keys = [set(k) for k in same["keys"]]
        first = np.array([min(keys[a] & keys[b]) == name for a, b in zip(i, j)], bool)
        i, j = i[first], j[first]
        e, copies = same["e"].to_numpy(), same["copies"].to_numpy()
        links = np.bincount(i, copies[j], len(e)) + np.bincount(j, copies[i], len(e))
        root = e.copy()
        while len(i):
            before = root.copy()
            np.minimum.at(root, i, before[j])
            np.minimum.at(root, j, before[i])
            if (root == before).all():
                break
        met = links > 0
        parts.append(pd.DataFrame({"e": e[met], "links": links[met].astype("int64"), "root": root[met]}))
    return pd.concat(parts, ignore_index=True)


def near_copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of vectors."""
    scratch = Scratch(vectors.sparkSession)
    v = F.col("v")
    sound = (F.coalesce(F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))), F.lit(False))
             & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    rows = scratch.keep(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
        .select("vec_id", "v", F.when(sound, F.xxhash64("v")).alias("e")))
    distinct = rows.where("e is not null").groupBy("e").agg(
        F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"), F.min("vec_id").alias("least"))
    distinct = scratch.keep(distinct)
    listed = scratch.keep(distinct.select("e", "copies", "v").mapInArrow(
        lambda it: _listed(it, tables, probes, scale),
        f"e long, copies long, v {rows.schema['v'].dataType.simpleString()}, keys array<long>"))
    keyed = listed.select(F.explode("keys").alias("key"), "e")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    places = (keyed.join(sizes, "key").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
              .withColumn("block", F.pmod(F.xxhash64("e"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("e", "key", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")))
    met = scratch.keep(places.join(listed, "e").groupBy("key", "one", "two").applyInPandas(
        lambda k, x: _compare(k, x, cosine), "e long, links long, root long"))
    label = components(met.select(F.col("e").alias("a"), F.col("root").alias("b")), scratch)
    in_group = (distinct.select("e", "copies", "least")
                .join(met.groupBy("e").agg(F.sum("links").alias("links")), "e", "left")
                .join(label.withColumnRenamed("node", "e"), "e", "left")
                .select("e", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least",
                        F.coalesce("label", "e").alias("label")))
    smallest = in_group.groupBy("label").agg(F.min("least").alias("component"))
    of_vector = scratch.keep(in_group.join(smallest, "label").select("e", "n_links", "component"))
    return rows.join(of_vector, "e", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("e").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
