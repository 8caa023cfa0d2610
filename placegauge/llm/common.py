"""What the operators share: word rules, row keys, tables kept in the shared folder, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placegauge.session import checkpoint_folder, require_checkpoint_folder

WORD_CACHE = 400_000
# Rows of an Arrow batch that are worked on at once.
SLICE_ROWS = 1_000

# Bytes that end a word become spaces, A-Z become a-z; bytes over 0x7F belong to words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share."""
    require_checkpoint_folder(spark)
    return checkpoint_folder(spark)


def keep(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet into the shared checkpoint folder and read from there.

    Cuts the lineage like a checkpoint, but columnar and compressed; a lost executor costs a
    re-read.  The table stays until the folder of the application is cleared.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_name(what: str) -> str:
    """A column name that no table of a caller has."""
    return f"{what}_{uuid.uuid4().hex}"


def alnum_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Windows:
    """Hashes of all runs of words of one length, as differences of running sums (mod 2**64)."""

    def __init__(self, multiplier: int) -> None:
        self.p = np.uint64(multiplier | 1)
        self.inverse = np.uint64(pow(multiplier | 1, -1, 2**64))
        self.powers = self.back = np.ones(1, dtype=np.uint64)

    def of(self, hashes: np.ndarray, length: int) -> np.ndarray:
        n = len(hashes) - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        powers, back = self.powers, self.back
        if len(powers) < len(hashes):
            size = 1 << len(hashes).bit_length()
            steps = np.full(size, self.p, dtype=np.uint64)
            turns = np.full(size, self.inverse, dtype=np.uint64)
            steps[0] = turns[0] = 1
            powers, back = np.cumprod(steps), np.cumprod(turns)
            if size <= 1 << 20:
                self.powers, self.back = powers, back
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * powers[: len(hashes)], out=sums[1:])
        return mixed((sums[length:] - sums[:n]) * back[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the result depends on every bit of the value."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def text_key(text: str | None) -> bytes:
    """128-bit key of a text; null and empty differ."""
    return b"null" if text is None else xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


_made: dict[str, tuple[str, object]] = {}
_asked = 0


def made_once(kind: str, source: str, make: Callable[[str], object]):
    """``make(source)``, kept in the Python worker for the tasks that follow; see ``worked``."""
    global _asked
    _asked += 1
    key = xxhash.xxh3_128_hexdigest(source)
    if _made.get(kind, ("", None))[0] != key:
        _made[kind] = (key, make(source))
    return _made[kind][1]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed; once a context."""
    context = spark.sparkContext
    if any(name.startswith("placegauge-") for name in getattr(context, "_python_includes", [])):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp()) / f"placegauge-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))


def arrow_rows(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema
) -> DataFrame:
    """``fn`` on every Arrow batch, inside the tasks."""

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return worked(batches, fn)

    return df.mapInArrow(run, schema)


def worked(
    batches: Iterator[pa.RecordBatch], fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]
) -> Iterator[pa.RecordBatch]:
    """``fn`` on slices of the batches of a task.

    Python workers live on through the steps of a job.  What ``made_once`` keeps (with its caches) goes
    after a task that had rows and did not ask for it, as then another step has begun.
    """
    before, rows = _asked, 0
    for batch in batches:
        rows += batch.num_rows
        for low in range(0, batch.num_rows, SLICE_ROWS):
            yield from fn(batch.slice(low, SLICE_ROWS))
    if rows and _asked == before:
        _made.clear()


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column out of one numpy array per row."""
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def joined_digest(values: Column) -> Column:
    """Lowercase SHA-256 hex of the strings, sorted and joined by commas."""
    return F.sha2(F.concat_ws(",", F.array_sort(values)), 256)


def spanning(i: np.ndarray, j: np.ndarray, size: int) -> list[int]:
    """Numbers of links that connect what all links connect."""
    root = list(range(size))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    tree = []
    for number, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            tree.append(number)
    return tree


def components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, component)`` of every node in ``edges(src, dst)``: the smallest id reachable.

    Alternates two steps until nothing changes: every node hands the smallest of its neighbours
    to its larger neighbours, then to its smaller ones.  Rounds grow with the logarithm of a
    chain, the number of edges never grows, and no link or component passes the driver.
    """
    edges = edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    ).distinct()
    edges = keep(edges, f"{name}-edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn(
            "m", F.least("src", "m")
        )
        # Larger neighbours of a node point to the smallest id around that node.
        wide = both.join(least, "src").where("dst > src").select(
            F.col("dst").alias("src"), F.col("m").alias("dst")
        ).distinct()
        # Smaller neighbours, and the node itself, do the same.
        low = wide.groupBy("src").agg(F.min("dst").alias("m"))
        linked = wide.join(low, "src")
        near = linked.where("dst <> m").select(
            F.col("dst").alias("src"), F.col("m").alias("dst")
        ).union(low.select("src", F.col("m").alias("dst")))
        edges = keep(near.distinct(), f"{name}-edges")
        # Stars only: every node points to one other, which points nowhere.
        now = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(
        edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )
