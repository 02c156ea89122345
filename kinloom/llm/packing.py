"""Sum-of-squares packing of token sequences.

A piece goes to the open bin (or a new one) after which the sum, over residual
gaps, of the squared number of open bins with that gap is smallest. Documents
longer than a bin are cut; a full piece is a bin by itself. Pieces are dealt
by hash into groups of `group_size` on average and packed group by group, so a
task's memory does not grow with the corpus and each group leaves only a few
bins open. A group is packed in two orders, by checksum and longest first, and
the one with fewer bins holds.

Defined results: a null or empty text is one piece of the end id. Repeated
rows are packed one by one. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, settle
from .tokens import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, room: int = 2048) -> DataFrame:
    """Cuts every encoded document into pieces of at most `room` ids, the first the shorter one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), struct.pack("<I", end_id)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode.ids(text.as_py() or "") + end
                n = len(ids) // 4
                first = n % room or room
                for k, stop in enumerate(range(first, n + 1, room)):
                    start = 0 if k == 0 else stop - room
                    out.append((doc_id, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE)


def sum_of_squares(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order."""
    count = np.zeros(room + 1, np.int64)  # open bins by gap; a gap of `room` stands for a new bin
    stacks: list[list[int]] = [[] for _ in range(room + 1)]
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    cost = np.zeros(room + 1, np.int64)  # 2 * count
    for i, s in enumerate(lengths.tolist()):
        # From gap g to g - s, the sum changes by 1 - 2 * count[g] and, unless the bin is then full, 1 + 2 * count[g - s].
        change = cost[: room + 1 - s] - cost[s:]
        change[0] -= 1  # a full bin is open no more
        open_ = count[s:] > 0
        change = np.where(open_, change, 1 << 60)
        change[room - s] = (cost[room - s] if s < room else -1) - 1
        g = int(change.argmin()) + s
        if g < room:
            b = stacks[g].pop()
            count[g] -= 1
            cost[g] -= 2
        else:
            b, used = used, used + 1
        bins[i], offsets[i] = b, room - g
        if g > s:
            stacks[g - s].append(b)
            count[g - s] += 1
            cost[g - s] += 2
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, room: int = 2048, group_size: int = 1 << 16) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; `group_size` pieces are packed together."""
    cut = settle(pieces(docs, tokenizer, end_id, room), "pieces")
    groups = max(1, round(cut.count() / group_size))

    def place(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        length = table.column("length").to_numpy()
        mixed = np.lexsort((table.column("doc_id").to_numpy(), table.column("piece").to_numpy(), table.column("ids_crc32").to_numpy()))
        best = None
        for order in (mixed, mixed[np.argsort(-length[mixed], kind="stable")]):  # arbitrary order, and longest first
            placed = sum_of_squares(length[order], room)
            if best is None or placed[0].max() < best[0].max():
                best, chosen = placed, order
        bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        bins[chosen], offsets[chosen] = best
        out = table.drop_columns(["group"])
        return out.append_column("sequence_id", pa.array((np.int64(group) << 32) + bins)).append_column("offset", pa.array(offsets))

    # The number of a row in the written table deals out repeated rows as well.
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return dealt.groupBy("group").applyInArrow(place, PACKED)
