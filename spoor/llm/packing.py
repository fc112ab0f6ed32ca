"""Problem 8: filling fixed-capacity containers with documents.

Method: bounded-space online packing. Each task keeps a fixed number of open
containers; an item goes to the fullest open one it fits into (best fit); if
it fits none and no more may be opened, the fullest is closed and emitted.
Containers still open at the end of a task are leftovers, at most ``OPEN`` a
task; they are merged as items of their own, in rounds, until one task sees
all that is left. Only sizes move: texts are counted in a narrow pass.

A document larger than a container is split into full containers and a rest,
which is packed like a document; no other is split.

Defined results
* null and empty texts have no token and lie in no container;
* a document id counts once;
* a container is full at ``CAPACITY`` tokens; a document of exactly that many
  is not split;
* an empty table gives no container; other columns are ignored.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.tokens import VOCABULARY, document_tokens
from spoor.runtime import load, materialize

CAPACITY = 4_096
#: Open containers a task keeps.
OPEN = 64
#: Leftovers merged by one task.
MERGE = 100_000


class OpenContainers:
    """At most ``limit`` open containers, best fit; ``close`` takes (members, used) of a closed one."""

    def __init__(self, capacity: int, limit: int, close):
        self.capacity, self.limit, self.close = capacity, limit, close
        self.free: list[tuple[int, int]] = []  # (free space, number), sorted
        self.members: dict[int, list] = {}
        self.next = 0

    def place(self, item, size: int) -> None:
        at = bisect.bisect_left(self.free, (size, -1))
        if at < len(self.free):
            space, number = self.free.pop(at)
        else:
            if len(self.free) >= self.limit:
                space, number = self.free.pop(0)
                self.close(self.members.pop(number), self.capacity - space)
            space, number = self.capacity, self.next
            self.next += 1
            self.members[number] = []
        self.members[number].append(item)
        if space == size:
            self.close(self.members.pop(number), self.capacity)
        else:
            bisect.insort(self.free, (space - size, number))

    def leftovers(self):
        for space, number in self.free:
            yield self.members.pop(number), self.capacity - space


def _pack_rows(capacity: int, limit: int, offset: int, keep_open: bool):
    """(item, size) rows to (item, container, open) rows."""

    def rows(batches):
        from pyspark import TaskContext

        base = (TaskContext.get().partitionId() + offset) << 36
        done: list[tuple] = []
        number = 0

        def close(members, used, open_=False):
            nonlocal number
            number += 1
            done.extend((m, base + number, used, open_) for m in members)

        held = OpenContainers(capacity, limit, close)

        def flush():
            if done:
                items, containers, used, open_ = zip(*done)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items, pa.int64()), pa.array(containers, pa.int64()), pa.array(used, pa.int32()), pa.array(open_, pa.bool_())],
                    names=["item", "container", "used", "open"],
                )
                done.clear()

        for batch in batches:
            for item, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.place(item, size)
            yield from flush()
        for members, used in held.leftovers():
            close(members, used, keep_open)
        yield from flush()

    return rows


_PLACED = "item long, container long, used int, open boolean"


def pack(items: DataFrame, capacity: int = CAPACITY, limit: int = OPEN, merge: int = MERGE) -> DataFrame:
    """(item, container): items (item long, size int <= capacity) packed; leftovers of all tasks merged."""
    placed = materialize(items.select("item", F.col("size").cast("int").alias("size")).mapInArrow(_pack_rows(capacity, limit, 0, True), _PLACED), "p8-placed")
    closed = placed.where(~F.col("open")).select("item", "container")
    open_ = placed.where("open").select("item", "container")
    left = placed.where("open").groupBy("container").agg(F.max("used").alias("size"))
    moved = open_.select("container", F.col("container").alias("now")).distinct()
    offset, last = 1 << 20, False
    while not last:
        n = left.count()
        tasks = -(-n // merge)
        last = tasks <= 1
        spread = left.select(F.col("container").alias("item"), "size")
        spread = spread.coalesce(1).sortWithinPartitions(F.desc("size"), "item") if last else spread.repartition(tasks, "item").sortWithinPartitions(F.desc("size"), "item")
        again = materialize(spread.mapInArrow(_pack_rows(capacity, 1 << 30 if last else limit, offset, not last), _PLACED), "p8-merged")
        moved = moved.join(again.select(F.col("item").alias("now"), F.col("container").alias("then")), "now", "left").select(
            "container", F.coalesce("then", "now").alias("now")
        )
        moved = materialize(moved, "p8-moved")
        left = again.where("open").groupBy("container").agg(F.max("used").alias("size"))
        offset += 1 << 20
    return closed.unionByName(open_.join(moved, "container").select("item", F.col("now").alias("container")))


def packed_documents(df: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container, doc_id, piece, start_token, n_tokens, n_pieces) of every document with a token."""
    sizes = document_tokens(df, vocabulary=vocabulary).where("n_tokens > 0")
    pieces = F.ceil(F.col("n_tokens") / capacity).cast("int")
    numbered = materialize(sizes.withColumn("item", F.monotonically_increasing_id()), "p8-sizes")
    split = numbered.select("doc_id", "item", "n_tokens", pieces.alias("n_pieces"))
    rest = split.select("item", (F.col("n_tokens") - (F.col("n_pieces") - 1) * capacity).alias("size"))
    packed = pack(rest, capacity).join(split, "item").select(
        F.concat_ws(".", F.lit("shared"), "container").alias("container"),
        "doc_id",
        (F.col("n_pieces") - 1).alias("piece"),
        ((F.col("n_pieces") - 1) * capacity).cast("bigint").alias("start_token"),
        (F.col("n_tokens") - (F.col("n_pieces") - 1) * capacity).cast("int").alias("n_tokens"),
        "n_pieces",
    )
    full = split.where("n_pieces > 1").select("doc_id", "item", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 2)).alias("piece"))
    whole = full.select(
        F.concat_ws(".", F.lit("whole"), "item", "piece").alias("container"),
        "doc_id",
        "piece",
        (F.col("piece") * capacity).cast("bigint").alias("start_token"),
        F.lit(capacity).alias("n_tokens"),
        "n_pieces",
    )
    return packed.unionByName(whole)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents larger than a container of 4,096 tokens, thus split: those that lie in more than one container."""
    packed = packed_documents(load(spark, sf_dir, "documents"))
    return packed.groupBy("doc_id").agg(F.count_distinct("container").alias("containers")).where("containers > 1").select("doc_id")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document, or piece of one, lies."""
    return packed_documents(load(spark, sf_dir, "documents")).drop("n_pieces")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, and the share of space used, against the least number of containers possible."""
    held = packed_documents(load(spark, sf_dir, "documents"))
    return held.agg(F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens")).select(
        "containers",
        "tokens",
        F.ceil(F.col("tokens") / CAPACITY).alias("least_containers"),
        F.round(F.col("tokens") / (F.col("containers") * CAPACITY), 4).alias("fill"),
    )


QUERIES = {"p8_found": p8_found, "p8_packed": p8_packed, "p8_fill": p8_fill}
# texts of at most 4,096 tokens and those of more differ by far in length
ORACLE: dict[str, str] = {"p8_found": "SELECT DISTINCT doc_id FROM documents WHERE length(text) > 5 * 4096"}
