"""Near-duplicate documents by b-bit MinHash.

A document is its set of distinct word shingles.  Documents with equal sets are one class; its
smallest id stands for it.  128 minima per set make 32 bands of 4, equal bands make candidates,
and the low 4 bits of each minimum, packed into 64 bytes, estimate the similarity of a candidate
pair: equal nibbles are counted and the share that agrees by chance is taken out.  Pairs whose
estimate is five standard errors below the threshold are dropped, all others are confirmed on the
full sets.  Equal bands miss a pair of similarity 0.8 with probability (1 - 0.8**4)**32 < 5e-8.

Candidates are not all pairs of a band.  First every document is compared with the smallest id of
each of its bands, and what that links becomes one component.  Only bands that still hold several
components are searched for pairs between components, in blocks of bounded size; such a pair is
taken in the first band that it shares.  Documents that were compared with the same one before carry
their difference to it, and two such differences give the exact similarity without the texts; only
other pairs are passed on to be confirmed.

Defined results: null texts and texts without words have an empty set and link with nothing; fewer
words than a shingle are one shingle; rows with one doc_id are one document with several texts;
rows with a null doc_id stand alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegauge.llm.common import (
    WordHashes,
    Windows,
    arrow_rows,
    components,
    keep,
    lists,
    lower_words,
    mixed,
    own_name,
    signed,
    spanning,
)

PERCENT = 80
BANDS, ROWS, BITS = 32, 4, 4
MINIMA = BANDS * ROWS
# Documents of one band that are compared at once.
BLOCK = 1024

_random = np.random.default_rng(20)
FACTORS = _random.integers(0, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1)
SHIFTS = _random.integers(0, 2**32, MINIMA, dtype=np.uint32)

SUMMARY = (
    "doc_id bigint, set_key binary, n_shingles bigint, bands array<bigint>, sketch binary"
)


def shingles(text: str | None, size: int, known: WordHashes, windows: Windows) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = lower_words(text)
    length = min(size, len(words))
    if not length:
        return np.zeros(0, dtype=np.uint64)
    hashes = windows.of(known.of(words), length)
    return np.unique(hashes if length == size else mixed(hashes + np.uint64(length)))


def minima(found: np.ndarray) -> np.ndarray:
    """Smallest value of each of the hash functions over a set."""
    x = (mixed(found) >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    for low in range(0, len(x), 4096):
        np.minimum(least, (x[low : low + 4096, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    return np.array(
        [xxhash.xxh3_64_intdigest(row.tobytes(), seed=k) for k, row in enumerate(rows)],
        dtype=np.uint64,
    )


def sketch(least: np.ndarray) -> bytes:
    """The low bits of every minimum, two to a byte."""
    low = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return (low[0::2] << BITS | low[1::2]).astype(np.uint8).tobytes()


def summaries(docs: DataFrame, size: int) -> DataFrame:
    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known, windows = WordHashes(), Windows(0xE7037ED1A0B428DB)
        keys, counts, bands, sketches = [], [], [], []
        for value in batch["text"]:
            found = shingles(value.as_py(), size, known, windows)
            keys.append(xxhash.xxh3_128_digest(found.tobytes()))
            counts.append(len(found))
            least = minima(found)
            bands.append(signed(band_keys(least)) if len(found) else np.zeros(0, dtype=np.int64))
            sketches.append(sketch(least))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(keys, pa.binary()), pa.array(counts, pa.int64()),
             lists(bands, pa.int64()), pa.array(sketches, pa.binary())],
            ["doc_id", "set_key", "n_shingles", "bands", "sketch"],
        )

    return arrow_rows(docs, read, SUMMARY)


def agreements(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Equal nibbles of packed sketches, by bit counts of their exclusive or."""
    x = one ^ two
    x = (x | (x >> np.uint64(1)) | (x >> np.uint64(2)) | (x >> np.uint64(3))) & np.uint64(0x1111111111111111)
    return MINIMA - np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def least_agreements(percent: int) -> float:
    """Agreements expected at the threshold, collisions included, less five standard errors."""
    wanted = percent / 100
    chance = wanted + (1 - wanted) / 2**BITS
    return MINIMA * chance - 5 * (MINIMA * chance * (1 - chance)) ** 0.5


def words_of(sketches: pa.Array) -> np.ndarray:
    raw = b"".join(sketches.to_pylist())
    return np.frombuffer(raw, dtype=np.uint64).reshape(len(sketches), -1)


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose sketches do not rule them out."""
    small = reps.select("doc_id", "sketch")
    rows = pairs.join(
        small.withColumnRenamed("doc_id", "a").withColumnRenamed("sketch", "sa"), "a"
    ).join(small.withColumnRenamed("doc_id", "b").withColumnRenamed("sketch", "sb"), "b")

    def test(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        same = agreements(words_of(batch["sa"]), words_of(batch["sb"]))
        yield batch.select(["a", "b"]).filter(pa.array(same >= least_agreements(percent)))

    return arrow_rows(rows.select("a", "b", "sa", "sb"), test, "a bigint, b bigint")


COMPARED = (
    "a bigint, b bigint, similar boolean, size_a bigint, size_b bigint, missing binary, added binary"
)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Comparison of the full sets; texts travel, as they compress well.

    ``missing`` has a bit for each shingle of ``b``, in the order of their hashes, that ``a`` has
    not; ``added`` has the hashes of ``a`` that ``b`` has not.
    """
    # Never by broadcast: the larger side grows with the corpus whatever the smaller one does.
    texts = texts.hint("merge")
    rows = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b"
    )

    def test(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known, windows = WordHashes(), Windows(0xE7037ED1A0B428DB)
        columns, last = [[] for _ in range(5)], (None, None)
        for ta, tb in zip(batch["ta"], batch["tb"], strict=True):
            text = tb.as_py()
            if last[0] != text:
                last = (text, shingles(text, size, known, windows))
            one, two = shingles(ta.as_py(), size, known, windows), last[1]
            missing = ~np.isin(two, one, assume_unique=True)
            added = one[~np.isin(one, two, assume_unique=True)]
            both = len(one) - len(added)
            union = len(one) + len(two) - both
            made = (bool(union) and 100 * both >= percent * union, len(one), len(two),
                    np.packbits(missing).tobytes(), added.tobytes())
            for column, value in zip(columns, made, strict=True):
                column.append(value)
        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [batch["a"], batch["b"], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
            ["a", "b", "similar", "size_a", "size_b", "missing", "added"],
        )

    return arrow_rows(rows.select("a", "b", "ta", "tb"), test, COMPARED)


class Family:
    """Rows of a block that were all compared with the same document."""

    def __init__(self, whole: int, missing: list[bytes], added: list[bytes]) -> None:
        width = -(-whole // 8)
        self.whole = whole
        self.missing = np.zeros((len(missing), width), dtype=np.uint8)
        owners: dict[int, list[int]] = {}
        self.added = []
        for row, (bits, hashes) in enumerate(zip(missing, added, strict=True)):
            if bits:
                self.missing[row] = np.frombuffer(bits, dtype=np.uint8)
            self.added.append(np.frombuffer(hashes, dtype=np.uint64).tolist())
            for value in self.added[-1]:
                owners.setdefault(value, []).append(row)
        self.shared = {value: rows for value, rows in owners.items() if len(rows) > 1}

    def intersections(self, row: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of one row with others."""
        gone = np.bitwise_count(self.missing[others] | self.missing[row]).sum(axis=1, dtype=np.int64)
        common = np.zeros(len(self.missing), dtype=np.int64)
        for value in self.added[row]:
            if value in self.shared:
                common[self.shared[value]] += 1
        return self.whole - gone + common[others]


def across(blocks: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked``: pairs of different components out of sorted rows of block pairs.

    Pairs with known differences are decided here, and enough of the links to connect what all of
    them connect are passed on; the others are likely pairs, still to be confirmed.  Rows come
    sorted by ``band, bi, bj``; a block pair may go on in the next batch.
    """
    least = least_agreements(percent)

    def pairs_of(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        ids, part, pivot, own, sizes, wholes = (
            group[c].to_numpy() for c in ("doc_id", "component", "pivot", "own", "size", "pivot_size")
        )
        sketches = words_of(group["sketch"].combine_chunks())
        keys = np.frombuffer(b"".join(group["keys"].to_pylist()), dtype=np.uint32).reshape(len(ids), -1)
        missing, added = group["missing"].to_pylist(), group["added"].to_pylist()
        families, place = {}, np.zeros(len(ids), dtype=np.int64)
        for name in np.unique(pivot).tolist():
            rows = np.flatnonzero(pivot == name)
            place[rows] = np.arange(len(rows))
            families[name] = Family(
                int(wholes[rows[0]]), [missing[r] for r in rows], [added[r] for r in rows]
            )
        band = int(group["place"][0].as_py())
        alone = group["bi"][0] == group["bj"][0]
        left = np.arange(len(ids)) if alone else np.flatnonzero(own == 0)
        right = left if alone else np.flatnonzero(own == 1)
        links, open_pairs = [], []
        for i in left:
            j = right[ids[right] > ids[i]] if alone else right
            j = j[part[j] != part[i]]
            j = j[~(keys[j, :band] == keys[i, :band]).any(axis=1)]  # met in an earlier band
            near = j[pivot[j] == pivot[i]]
            if len(near):
                both = families[int(pivot[i])].intersections(int(place[i]), place[near])
                near = near[100 * both >= percent * (sizes[i] + sizes[near] - both)]
                links.append(np.stack([np.full(len(near), i), near]))
            far = j[pivot[j] != pivot[i]]
            far = far[agreements(sketches[far], sketches[i]) >= least]
            open_pairs.append(np.stack([np.full(len(far), i), far]))
        if links:
            found = np.concatenate(links, axis=1)
            found = found[:, spanning(found[0], found[1], len(ids))]
            yield ids[found[0]], ids[found[1]], True
        if open_pairs:
            found = np.concatenate(open_pairs, axis=1)
            yield ids[found[0]], ids[found[1]], False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
            marks = group_starts(rest)
            yield from emit(rest, marks)
            rest = rest.slice(marks[-1])
        if rest is not None:
            yield from emit(rest, [0, rest.num_rows])

    def group_starts(table: pa.Table) -> list[int]:
        named = [table[c].to_numpy() for c in ("band", "bi", "bj")]
        new = np.ones(table.num_rows, dtype=bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in named], axis=0)
        return np.flatnonzero(new).tolist()

    def emit(table: pa.Table, marks: list[int]) -> Iterator[pa.RecordBatch]:
        for low, high in zip(marks, marks[1:], strict=False):
            for a, b, linked in pairs_of(table.slice(low, high - low)):
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array([linked] * len(a))],
                        ["a", "b", "linked"],
                    )

    return blocks.mapInArrow(run, "a bigint, b bigint, linked boolean")


def classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Summaries of all rows, and ``doc_id, component`` of every linked class representative."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    seen = keep(summaries(docs, size), "near-summaries")
    known = seen.where("n_shingles > 0 and doc_id is not null")
    firsts = known.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    # Both columns: the rows of one large class are dealt to all tasks.
    reps = known.join(firsts, ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key", "doc_id"])
    reps = keep(reps.select("doc_id", "n_shingles", "bands", "sketch"), "near-classes")

    # Hashes of bands include the band, so one number names a bucket.
    rows = reps.select("doc_id", F.posexplode("bands").alias("place", "band"))
    buckets = rows.groupBy("band").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    buckets = keep(buckets, "near-buckets")
    rows = keep(rows.join(buckets, "band"), "near-rows")
    stars = rows.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    near = keep(likely(stars, reps, percent), "near-likely")
    # All texts move once; afterwards only those of documents that share a band with another.
    texts = docs.join(rows.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    texts = keep(texts, "near-texts")
    tested = keep(confirmed(near, texts, size, percent), "near-tested")
    links = tested.where("similar").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    linked = components(links, "near-first")

    # The smallest document that each was compared with, and the difference to it.
    seats = tested.groupBy("a").agg(
        F.min(F.struct("b", "size_b", "size_a", "missing", "added")).alias("s")
    ).select(F.col("a").alias("doc_id"), "s.*")
    empty = F.lit(b"")
    state = (
        reps.join(linked.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .join(seats, "doc_id", "left")
        .select(
            "doc_id", "sketch", "bands", F.coalesce("component", "doc_id").alias("component"),
            F.coalesce("b", "doc_id").alias("pivot"), F.coalesce("size_b", "n_shingles").alias("pivot_size"),
            F.coalesce("size_a", "n_shingles").alias("size"), F.coalesce("missing", empty).alias("missing"),
            F.coalesce("added", empty).alias("added"),
        )
    )
    state = keep(state, "near-state")
    members = rows.select("band", "place", "n", "doc_id").join(state.select("doc_id", "component"), "doc_id")
    split = members.groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low < high").select("band")
    open_rows = members.join(split, "band").select("band", "place", "n", "doc_id")
    # Blocks by hash; a row goes to the pair of its block with every block of the bucket.
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("count")).cast("int")
    blocks = open_rows.withColumn("count", count).withColumn("mine", mine).select(
        "band", "place", "doc_id", "mine", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("other")
    ).select(
        "band", "place", "doc_id", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"),
        (F.col("mine") > F.col("other")).cast("int").alias("own"),
    )
    attached = blocks.join(state, "doc_id").select(
        "band", "bi", "bj", "own", "place", "doc_id", "component", "pivot", "pivot_size", "size",
        "missing", "added", "sketch", "bands",
    )
    attached = short_keys(attached)
    dealt = attached.repartition("band", "bi", "bj").sortWithinPartitions("band", "bi", "bj", "own")
    more = keep(across(dealt, percent).distinct(), "near-across")
    tested = confirmed(more.where("not linked").select("a", "b"), texts, size, percent)
    late = more.where("linked").select("a", "b").union(tested.where("similar").select("a", "b"))
    late = late.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    every = components(links.union(late), "near-last")
    return seen, every


def short_keys(rows: DataFrame) -> DataFrame:
    """32 bits of every band, packed, instead of the array."""

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flat = batch["bands"].flatten().to_numpy()
        # A chance equality of 32 bits in an earlier band hides a pair with odds of 31 to 2**32.
        raw = np.ascontiguousarray((flat.view(np.uint64) >> np.uint64(32)).astype(np.uint32)).tobytes()
        step = 4 * BANDS
        keys = [raw[k : k + step] for k in range(0, len(raw), step)]
        at = batch.schema.get_field_index("bands")
        yield batch.set_column(at, "keys", pa.array(keys, pa.binary()))

    kept = [f for f in rows.schema.simpleString()[7:-1].split(",") if not f.startswith("bands")]
    return arrow_rows(rows, pack, ", ".join(f.replace(":", " ") for f in [*kept, "keys:binary"]))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    seen, linked = classes(docs, size, percent)
    narrow = seen.select("doc_id", "set_key", "n_shingles")
    firsts = narrow.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("first"))
    named = firsts.join(linked.select(F.col("node").alias("first"), "component"), "first", "left")
    named = named.select("set_key", F.coalesce("component", "first").alias("component"))
    made = narrow.join(named, "set_key", "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return made.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group (the smallest id), and every row that links with nothing."""
    gone_id = own_name("gone")
    gone = near_duplicates(docs.select("doc_id", "text"), size, percent).where("not kept").select(
        F.col("doc_id").alias(gone_id)
    ).distinct()
    return docs.join(gone, F.col("doc_id").cast("bigint") == F.col(gone_id), "left_anti")
