"""Packing by bounded space: a fixed number of open windows in each partition, best fit, the fullest is emitted.

A document is its token ids and an end id; a null text is an empty one, so it is the end id alone. A piece goes to
the open window with the least room that holds it. If none does, the fullest window takes as much of the piece as
it has room for and is emitted, and the rest opens a new one. What is left open at the end of each partition is
merged over LEFTOVER_PARTITIONS partitions at a time. Rows stay apart, also for repeated or null doc_id. An empty table
gives no piece; columns other than the two named ones are not looked at; a long text is cut into full windows as it is read.
"""

import base64
import zlib
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, encode, hand_back, slices, written

CAPACITY = 1024
OPEN_WINDOWS = 32
END_ID = 0
LEFTOVER_PARTITIONS = 64
SPECIAL = "<|endoftext|>"
#: sequence_id is a partition number times this, plus a count; merged leftovers count from the far half.
PER_PARTITION = 1 << 36
_PIECE = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Encoder:
    """Ids of the tokenizer file. Its twin in ranks form gives the same ids several times faster; texts with
    the special token, and those that the twin can't take, go to the tokenizer file itself."""

    def __init__(self, path: str):
        self.path, self.fast = path, None
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
            self.fast = tiktoken.Encoding(ranks.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @cached_property
    def slow(self):
        """Loaded with the first text that needs it: it takes several times the twin's memory."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        ids = None
        if self.fast and SPECIAL not in text:
            try:
                ids = self.fast.encode_ordinary(text)
            except BaseException as e:  # the twin's own panic on extreme runs of white space is no Exception
                if type(e).__name__ != "PanicException":
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids if ids is None else ids, np.uint32)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Windows:
    """At most `most` open windows. A piece is (doc_id, start, ids, doc_tokens); emitted windows are lists of pieces."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open, self.done = capacity, most, [], []

    def put(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.capacity:
            self.done.append([(doc_id, start, ids[: self.capacity], total)])
            start, ids = start + self.capacity, ids[self.capacity :]
        if not len(ids):
            return
        fits = [w for w in self.open if w[0] >= len(ids)]
        if fits:
            best = min(fits, key=lambda w: w[0])
        elif len(self.open) < self.most:
            best = [self.capacity, []]
            self.open.append(best)
        else:
            best = min(self.open, key=lambda w: w[0])
            room = best[0]
            self._add(best, doc_id, start, ids[:room], total)
            start, ids = start + room, ids[room:]
            best = [self.capacity, []]
            self.open.append(best)
        self._add(best, doc_id, start, ids, total)

    def _add(self, window: list, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        window[1].append((doc_id, start, ids, total))
        window[0] -= len(ids)
        if not window[0]:
            self.open = [w for w in self.open if w is not window]
            self.done.append(window[1])


def _rows(windows: list[list], first: int, kind: pa.DataType, left: bool | None = None) -> pa.RecordBatch:
    flat = [(d, s, ids, n, first + k, o) for k, w in enumerate(windows) for (d, s, ids, n), o in zip(w, np.cumsum([0, *(len(p[2]) for p in w)]))]
    longs = lambda i: pa.array([int(x[i]) for x in flat], pa.int64())
    columns = {"doc_id": pa.array([x[0] for x in flat], kind), "start": longs(1), "length": pa.array([len(x[2]) for x in flat], pa.int64()), "ids_crc32": pa.array([crc(x[2]) for x in flat], pa.int64()), "doc_tokens": longs(3), "sequence_id": longs(4), "offset": longs(5)}
    if left is not None:
        columns["left"] = pa.array([x[2].astype("<u4").tobytes() if left else None for x in flat], pa.binary())
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = _PIECE.format(id=kind)

    def place(batches):
        encoder, windows, part = Encoder(tokenizer), Windows(capacity, open_windows), TaskContext.get().partitionId()
        count, id_type = 0, None
        for batch in batches:
            id_type = batch.column(0).type
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for a, b in slices([encode(t) for t in texts]):
                for d, t in zip(ids[a:b], texts[a:b]):
                    tokens = np.append(encoder(t), np.uint32(END_ID)).astype(np.uint32)
                    windows.put(d, 0, tokens, len(tokens))
                if windows.done:
                    yield _rows(windows.done, part * PER_PARTITION + count, id_type, False)
                    count += len(windows.done)
                    windows.done = []
        if windows.open:
            yield _rows([w[1] for w in windows.open], part * PER_PARTITION + count, id_type, True)
        del encoder, windows
        hand_back()

    def merge(table: pa.Table) -> pa.Table:
        windows, rows = Windows(capacity, 1), table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        first = rows[0]["sequence_id"] // PER_PARTITION * PER_PARTITION + PER_PARTITION // 2
        for r in rows:
            windows.put(r["doc_id"], r["start"], np.frombuffer(r["left"], "<u4"), r["doc_tokens"])
        return pa.Table.from_batches([_rows(windows.done + [w[1] for w in windows.open], first, table.schema.field("doc_id").type)])

    picked = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    pieces = written(picked.mapInArrow(place, f"{schema}, left binary"), "pieces")
    group = F.floor(F.col("sequence_id") / F.lit(PER_PARTITION * LEFTOVER_PARTITIONS))
    merged = pieces.filter("left is not null").groupBy(group).applyInArrow(merge, schema)
    return pieces.filter("left is null").drop("left").unionByName(merged)
