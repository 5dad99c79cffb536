"""Sum-of-squares packing of tokenised documents into sequences of fixed length.

A document is its token ids and an end id. Longer ones are cut into full pieces, of which
the first may be shorter. Full pieces are sequences. The rest is packed, longest first,
in groups of bounded size: each piece goes to the residual gap (or a new sequence) for
which the sum of squares of the numbers of open sequences per gap becomes smallest.

Defined results: a null or empty text is the end id alone; equal rows are packed one by
one; an empty table gives no rows; further columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmine.llm import tokens, vec
from conceptmine.session import materialize

LENGTH = 2048
END_ID = 0
#: Pieces that are packed together, about: the memory and the time of one task. The open sequences
#: that each group ends with are some thousandths of its sequences.
GROUP = 50_000


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece, placed in the given order."""
    open_ = np.zeros(length + 1, np.int64)  # open sequences by gap
    waiting: list[list[int]] = [[] for _ in range(length + 1)]
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    made = 0
    for i, size in enumerate(sizes.tolist()):
        # one less of gap g and one more of gap g - size: the change of the sum of squares, by g from size on
        change = 2 * (open_[:length + 1 - size] - open_[size:]) + 2
        change[0] = 1 - 2 * open_[size]  # a full sequence is not open
        change[open_[size:] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        if change[best] <= 2 * open_[length - size] + 1:
            gap = best + size
            to = waiting[gap].pop()
            open_[gap] -= 1
        else:
            gap, to = length, made
            made += 1
        sequence[i], offset[i] = to, length - gap
        if gap > size:
            open_[gap - size] += 1
            waiting[gap - size].append(to)
    return sequence, offset


def pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
           keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: place in it, length, and the check sum of the ids (the ids too if wanted)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode
        for batch in batches:
            for part, buf, offsets in vec.slices(batch, "_text"):
                ids, bounds = encode(buf, offsets)
                owner, piece, start, size, crc, lists = [], [], [], [], [], []
                for t, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                    cuts = [0, *range(len(own) % length or length, len(own) + 1, length)]
                    for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                        owner.append(t)
                        piece.append(k)
                        start.append(x)
                        size.append(y - x)
                        crc.append(zlib.crc32(own[x:y].tobytes()))
                        if keep_ids:
                            lists.append(own[x:y].astype(np.int32))
                out = [part.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
         group: int = GROUP, keep_ids: bool = False) -> DataFrame:
    """All pieces with their ``sequence_id`` and ``offset``."""
    cut = pieces(docs, vocabulary, doc_id, text, length, keep_ids)
    cut = materialize(cut.withColumn("_row", F.monotonically_increasing_id()))
    rest = cut.where(F.col("length") < length)
    groups = -(-max(1, rest.count()) // group)
    keyed = rest.select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group"))

    def place(table: pa.Table) -> pa.Table:
        size, row = table.column("length").to_numpy(), table.column("_row").to_numpy()
        order = np.lexsort((row, -size))
        sequence, offset = sum_of_squares(size[order], length)
        number = (table.column("_group").to_numpy()[0] << 32) + sequence
        return pa.table({"_row": row[order], "sequence_id": number, "offset": offset})

    placed = keyed.groupBy("_group").applyInArrow(place, "_row long, sequence_id long, offset long")
    out = rest.join(placed, "_row").unionByName(cut.where(F.col("length") == length).withColumns(
        {"sequence_id": -1 - F.col("_row"), "offset": F.lit(0).cast("long")}))
    return out.drop("_row")
