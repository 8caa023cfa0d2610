"""Token ids of all documents, in ascending order of their ids, in compressed binary files.

Documents are dealt by ranges of doc_id, so the order of partitions and of rows inside them is the
order of documents.  A group holds whole documents, about two million ids, as one binary value (see
``id_coder``), and can be read and checked on its own; Parquet is the container, so any store that
Spark reaches will do.  A task holds one group at a time.

Defined results: a null text is an empty one; a null doc_id comes first; rows with equal doc_id are
ordered by text; an empty table gives no groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placegauge.llm import id_coder
from placegauge.llm.common import arrow_rows, ship
from placegauge.llm.tokens import END_ID, encoder, read_vocabulary

GROUP_IDS = id_coder.BLOCKS * id_coder.BLOCK_IDS[0]

FILE = "part int, number int, n_ids bigint, data binary"


def write_ids(docs: DataFrame, vocabulary_path: str, path: str) -> None:
    """Encode every text, append the end id, and write the groups to ``path``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    end = END_ID.to_bytes(4, "little")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = encoder(shared.value).ids, TaskContext.get().partitionId()
        keys, held, size, number = [], [], 0, 0

        def group() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            data = id_coder.write_group(keys, [len(raw) // 4 for raw in held], ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())],
                ["part", "number", "n_ids", "data"],
            )

        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                keys.append(key.as_py())
                held.append(ids_of(text.as_py()) + end)
                size += len(held[-1]) // 4
                if size >= GROUP_IDS:
                    yield group()
                    keys, held, size, number = [], [], 0, number + 1
        if keys:
            yield group()

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(groups, FILE).write.option("compression", "none").parquet(path)


def group_documents(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The documents of every group of a batch."""
    for part, number, data in zip(batch["part"], batch["number"], batch["data"], strict=True):
        keys, lengths, ids = id_coder.read_group(data.as_py())
        ends = np.cumsum(lengths, dtype=np.int64)
        # Arrow's 2 GB limit of a binary column is far above a group.
        offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
        documents = pa.Array.from_buffers(
            pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())]
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array([part.as_py()] * len(keys), pa.int32()),
             pa.array([number.as_py()] * len(keys), pa.int32()), pa.array(keys, pa.int64()),
             pa.array(ends - lengths), documents],
            ["part", "number", "doc_id", "at", "ids"],
        )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``part, number, doc_id, at (ids of the group before it), ids (bytes)`` of every document."""
    return arrow_rows(
        spark.read.schema(FILE).parquet(path).select("part", "number", "data"), group_documents,
        "part int, number int, doc_id bigint, at bigint, ids binary",
    )


def group_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids of all groups before each group; totals of parts first, then sums inside a part."""
    sizes = spark.read.schema(FILE).parquet(path).select("part", "number", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row for each partition that wrote.
    before = parts.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    return sizes.withColumn("inside", inside).join(before, "part").select(
        "part", "number", (F.col("before") + F.col("inside")).alias("group_start")
    )


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files."""

    def digests(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for documents in group_documents(batch):
            raw = [value.as_buffer() for value in documents["ids"]]
            yield pa.RecordBatch.from_arrays(
                [*documents.columns[:4], pa.array([len(r) // 4 for r in raw], pa.int64()),
                 pa.array([zlib.crc32(r) for r in raw], pa.int64())],
                [*documents.schema.names[:4], "n_tokens", "ids_crc32"],
            )

    # Ids go no further than the task that read them.
    documents = arrow_rows(
        spark.read.schema(FILE).parquet(path).select("part", "number", "data"), digests,
        "part int, number int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint",
    )
    return documents.join(group_starts(spark, path), ["part", "number"]).select(
        "doc_id", (F.col("group_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
