"""Filling containers of a fixed capacity with items of varying length.

Hierarchical residual packing: each partition packs its own items by best fit, largest first, and emits the containers that are nearly
full. Of the underfull ones those that can still take something go on as items to fewer, merged partitions, which pack them together, and so on up a tree, until one
partition is left. Only sizes and ids travel, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .tokens import n_tokens

_BIN = "ids array<bigint>, pieces array<int>, sizes array<bigint>, filled bigint"
#: The same in Arrow. Spark's batches name the lists' items otherwise and say what is never NULL; tables are put together only if all that is alike.
_BINS = pa.schema([("ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int64())), ("filled", pa.int64())])


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items by container: best fit, largest item first. The rooms left are the bits of a number, so the tightest fit is its lowest bit from the item's size on."""
    bins: list[list[int]] = []
    with_room: dict[int, list[int]] = {}
    rooms = 0
    for n in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[n])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = with_room[room]
            at = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
            bins[at].append(n)
        else:
            room, at = capacity, len(bins)
            bins.append([n])
        room -= size
        if room:
            with_room.setdefault(room, []).append(at)
            rooms |= 1 << room
    return bins


def _joined(t: pa.Table, capacity: int) -> pa.Table:
    """The containers of t (each an item here) put together by best fit."""
    filled = t["filled"].to_numpy()
    bins = best_fit(filled, capacity)
    # a container's items are those of the bins put into it
    order = pa.array(np.concatenate([np.array(b, np.int64) for b in bins]))
    ends = np.cumsum([len(b) for b in bins])
    out = {}
    for c in ("ids", "pieces", "sizes"):
        taken = t[c].combine_chunks().take(order)
        values, offsets = taken.flatten(), np.concatenate([[0], np.cumsum(taken.value_lengths().to_numpy(zero_copy_only=False))])
        out[c] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], offsets[ends]]).astype(np.int32)), values)
    out["filled"] = pa.array(np.add.reduceat(filled[order.to_numpy()], np.concatenate([[0], ends[:-1]])))
    return pa.table(out)


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, enough: int, hosts: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """The containers of a partition, packed at_once items at a time; open ones go on to the next items, those still open at the end have `open`.

    Best fit leaves at most one container that is half full or less. The others are too full for one another, so only the emptiest `hosts` of them are worth keeping open for what comes.
    """
    left = _BINS.empty_table()
    waiting: list[pa.Table] = []

    def settle() -> tuple[pa.Table, pa.Table]:
        t = pa.concat_tables([left, *waiting])
        if not len(t):
            return t, t
        t = _joined(t, capacity)
        filled = t["filled"].to_numpy()
        by_room = np.argsort(filled, kind="stable")
        by_room = by_room[filled[by_room] < enough][: hosts + 1]
        stay = np.zeros(len(filled), bool)
        stay[by_room] = True
        return t.filter(pa.array(~stay)), t.filter(pa.array(stay))

    for b in batches:
        if b.num_rows:
            waiting.append(pa.Table.from_batches([b]).cast(_BINS))
        if sum(x.num_rows for x in waiting) >= at_once:
            closed, left = settle()
            waiting = []
            yield from closed.append_column("open", pa.array([False] * len(closed), pa.bool_())).to_batches(max_chunksize=10_000)
    closed, left = settle()
    for t, is_open in ((closed, False), (left, True)):
        yield from t.append_column("open", pa.array([is_open] * len(t), pa.bool_())).to_batches(max_chunksize=10_000)


def pack(items: DataFrame, capacity: int, full: float = 0.995, fan_in: int = 8, at_once: int = 100_000) -> DataFrame:
    """(doc_id, piece, tokens, container) from items (doc_id a number, tokens): each item whole in one container, if it isn't larger than one.

    An item above the capacity gives pieces 0, 1, ... as large as a container, which fill one each, and a last piece with the rest. An item without tokens (NULL
    or 0) takes no space: one row with a NULL container. container is a number of its own for each container. Each row is an item, with a NULL
    or repeated id too. A container filled to `full` or more isn't opened again. A partition packs at_once items at a time and hands on the few containers that can still take something;
    those of fan_in partitions are packed together, and so on, until one partition has seen what all the others left.
    An empty table gives an empty result.
    """
    sized = items.select("doc_id", F.coalesce(F.col("tokens").cast("bigint"), F.lit(0).cast("bigint")).alias("tokens"))
    empty = sized.where("tokens <= 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("tokens"), F.lit(None).cast("bigint").alias("container"))
    n_full = F.floor(F.col("tokens") / capacity)
    rest = F.col("tokens") % capacity
    pieces = sized.where("tokens > 0").select("doc_id", F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.greatest(n_full, F.lit(1))), lambda k: F.struct((k - 1).cast("int").alias("piece"), F.when(k <= n_full, F.lit(capacity)).otherwise(F.lit(0)).cast("bigint").alias("size"))), F.array(F.struct(n_full.cast("int").alias("piece"), rest.alias("size"))))).alias("p")).where("p.size > 0").select("doc_id", "p.piece", F.col("p.size").alias("size"))
    single = pieces.select(F.array(F.col("doc_id").cast("bigint")).alias("ids"), F.array("piece").alias("pieces"), F.array("size").alias("sizes"), F.col("size").alias("filled"))
    enough = int(capacity * full)
    packed = lambda df: df.mapInArrow(lambda b: _pack(b, capacity, enough, fan_in, at_once), f"{_BIN}, open boolean")

    bins = kept(packed(single).withColumn("part", F.spark_partition_id()))
    left, done = bins.where("open"), [bins.where("NOT open")]
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // fan_in)
        # a few containers of each of fan_in partitions
        merged = kept(packed(left.repartition(parts, F.floor(F.col("part") / fan_in)).select("ids", "pieces", "sizes", "filled") if parts > 1 else left.coalesce(1).select("ids", "pieces", "sizes", "filled")).withColumn("part", F.spark_partition_id()))
        done.append(merged.where("NOT open"))
        left = merged.where("open")
    done.append(left)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    rows = out.select(F.monotonically_increasing_id().alias("container"), "ids", "pieces", "sizes").select("container", F.explode(F.arrays_zip("ids", "pieces", "sizes")).alias("x")).select(F.col("x.ids").alias("doc_id"), F.col("x.pieces").alias("piece"), F.col("x.sizes").alias("tokens"), "container")
    return rows.unionByName(empty.select(*rows.columns))


def pack_documents(documents: DataFrame, capacity: int = 8192) -> DataFrame:
    """(doc_id, piece, tokens, container) for the texts of documents, sized in tokens; see pack."""
    return pack(documents.select("doc_id", n_tokens(F.col("text")).alias("tokens")), capacity)
