"""Near-duplicate embeddings by cross-polytope hashing.

Vectors are rotated by three rounds of random signs and a fast Hadamard transform; the axis with the
largest coordinate, and its sign, is the hash.  Two hashes make a bucket of a table.  Besides its
own bucket a vector also looks into those where one hash is the second largest axis (multiprobe).
Every pair that shares a bucket is verified by its cosine in double precision, inside blocks of
bounded size; a pair counts in the first bucket it shares, so blocks send on counts for each
vector and a spanning set of links, never the pairs.

A pair at the threshold shares no bucket of a table with probability 0.275 (measured, 64
dimensions), of all ten tables with 2.5e-6.

Defined results: vectors with a null or non-finite component, zero vectors, null vectors and rows
with a null label or id link with nothing; vectors of different lengths do not link; equal vectors
of one label are one class and link with each other; rows with one id are one vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegauge.llm.common import arrow_rows, components, keep, lists, mixed, signed, spanning

COSINE = 0.93
TABLES, PROBES = 10, 3
BLOCK = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, length a power of two; keeps lengths."""
    rows, size = x.shape
    half = 1
    while half < size:
        x = x.reshape(rows, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, size)
        half *= 2
    return x / np.sqrt(size)


def vertices(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The two vertices of the cross-polytope nearest to the rotated rows: axis and sign."""
    for flip in signs:
        x = hadamard(x * flip)
    order = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :2]
    return order * 2 + (np.take_along_axis(x, order, axis=1) < 0)


def buckets(units: np.ndarray, labels: np.ndarray, seed: int = 3) -> np.ndarray:
    """Bucket keys of every row: tables times probes."""
    dim = units.shape[1]
    size = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((len(units), size))
    padded[:, :dim] = units
    random = np.random.default_rng([seed, dim])
    keys = []
    for number in range(TABLES):
        signs = random.choice([-1.0, 1.0], size=(2, 3, size))
        one, two = (vertices(padded, s) for s in signs)
        for i, j in ((0, 0), (1, 0), (0, 1))[:PROBES]:
            code = ((number * 2 * size + one[:, i]) * 2 * size + two[:, j]).astype(np.uint64)
            keys.append(mixed(code + mixed(labels.view(np.uint64) + np.uint64(dim << 32))))
    return np.stack(keys, axis=1)


def summaries(vectors: DataFrame) -> DataFrame:
    """``vec_id, class_key, unit (bytes of doubles), keys`` of the vectors that can link."""

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list] = {}
        for vec_id, values, label in zip(batch["vec_id"], batch["embedding"], batch["label"], strict=True):
            if not (vec_id.is_valid and values.is_valid and label.is_valid):
                continue
            row = values.values
            if not len(row) or row.null_count:
                continue
            x = row.to_numpy().astype(np.float64)
            largest = np.abs(x).max()
            if not np.isfinite(largest) or largest == 0 or not np.isfinite(x).all():
                continue
            x = x / largest  # lengths neither overflow nor vanish
            groups.setdefault(len(x), []).append((vec_id.as_py(), label.as_py(), x))
        for rows in groups.values():
            labels = np.array([r[1] for r in rows], dtype=np.int64)
            units = np.array([r[2] for r in rows])
            units /= np.sqrt((units * units).sum(axis=1, keepdims=True))
            keys = buckets(units, labels)
            marks = [
                xxhash.xxh3_128_digest(int(label).to_bytes(8, "little", signed=True) + unit.tobytes())
                for label, unit in zip(labels, units, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array(marks, pa.binary()),
                 pa.array([u.tobytes() for u in units], pa.binary()),
                 lists([signed(k) for k in keys], pa.int64())],
                ["vec_id", "class_key", "unit", "keys"],
            )

    rows = vectors.selectExpr("cast(vec_id as bigint) vec_id", "embedding", "cast(label as bigint) label")
    return arrow_rows(rows, read, "vec_id bigint, class_key binary, unit binary, keys array<bigint>")


def verified(blocks: DataFrame, least: float) -> DataFrame:
    """``a, b, weight``: for a vector, how many others of its block pair it links with (b null),
    and links that connect the block (weight null).  Rows come sorted by block pair."""

    def links_of(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, own, copies = (group[c].to_numpy() for c in ("vec_id", "own", "copies"))
        units = np.frombuffer(b"".join(group["unit"].to_pylist()), dtype=np.float64).reshape(len(ids), -1)
        keys = np.stack(group["keys"].to_numpy()).astype(np.int64)
        band = group["bucket"][0].as_py()
        alone = group["bi"][0] == group["bj"][0]
        left = np.arange(len(ids)) if alone else np.flatnonzero(own == 0)
        right = left if alone else np.flatnonzero(own == 1)
        if not len(left) or not len(right):
            return
        near = units[left] @ units[right].T >= least
        if alone:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        first = first_shared(keys[left[i]], keys[right[j]]) == band
        i, j = left[i[first]], right[j[first]]
        if not len(i):
            return
        counts = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        some = np.flatnonzero(counts)
        tree = spanning(i, j, len(ids))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids[some], ids[i[tree]]])),
             pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[j[tree]])]),
             pa.concat_arrays([pa.array(counts[some].astype(np.int64)), pa.nulls(len(tree), pa.int64())])],
            ["a", "b", "weight"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            piece = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, piece]) if rest is not None else piece
            marks = starts(rest)
            for low, high in zip(marks, marks[1:], strict=False):
                yield from links_of(rest.slice(low, high - low))
            rest = rest.slice(marks[-1])
        if rest is not None and rest.num_rows:
            yield from links_of(rest)

    def starts(rows: pa.Table) -> list[int]:
        named = [rows[c].to_numpy() for c in ("bucket", "bi", "bj")]
        new = np.ones(rows.num_rows, dtype=bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in named], axis=0)
        return np.flatnonzero(new).tolist() or [0]

    return blocks.mapInArrow(run, "a bigint, b bigint, weight bigint")


def first_shared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The first key of each row of ``one`` that the row of ``two`` has in the same table.

    Tables are looked at one by one; within a table by the smallest shared key.
    """
    found = np.zeros(len(one), dtype=np.int64)
    open_rows = np.ones(len(one), dtype=bool)
    for table in range(TABLES):
        part = slice(table * PROBES, (table + 1) * PROBES)
        same = one[:, part, None] == two[:, None, part]
        shared = np.where(same.any(axis=2), one[:, part], np.iinfo(np.int64).max).min(axis=1)
        hit = open_rows & same.any(axis=(1, 2))
        found[hit] = shared[hit]
        open_rows &= ~hit
    return found


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    seen = keep(summaries(vectors), "vector-summaries")
    # Equal vectors of one label are one class.
    members = seen.select("vec_id", "class_key").distinct()
    sizes = members.groupBy("class_key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    sizes = keep(sizes, "vector-classes")
    # Both columns: the rows of one large class are dealt to all tasks.
    reps = seen.join(sizes, ["class_key", "vec_id"]).dropDuplicates(["class_key", "vec_id"])
    reps = keep(reps, "vector-reps")
    rows = reps.select("vec_id", F.explode("keys").alias("bucket")).distinct()
    many = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(many, "bucket")
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    blocks = rows.withColumn("count", count).withColumn(
        "mine", F.pmod(F.xxhash64("vec_id"), F.col("count")).cast("int")
    ).select(
        "bucket", "vec_id", "mine", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("other")
    ).select(
        "bucket", "vec_id", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"),
        (F.col("mine") > F.col("other")).cast("int").alias("own"),
    )
    attached = blocks.join(reps.select("vec_id", "class_key", "unit", "keys", "copies"), "vec_id")
    dealt = attached.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    found = keep(verified(dealt, cosine), "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("first")).agg(F.sum("weight").alias("others"))
    linked = components(
        found.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")),
        "vector-components",
    ).withColumnRenamed("node", "first")
    named = sizes.withColumnRenamed("vec_id", "first").join(counts, "first", "left").join(
        linked, "first", "left"
    ).select(
        "class_key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("component", "first").alias("component"),
    )
    # An id that comes with several vectors takes the links of all.
    each = members.join(named, "class_key").groupBy("vec_id").agg(
        F.sum("links").alias("links"), F.min("component").alias("component")
    )
    every = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id")).join(each, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return every.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
