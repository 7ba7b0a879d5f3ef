"""Byte-level BPE: texts to ids of a rank file and back, by recursive DuckDB queries inside each Spark partition.

A word is a match of the split pattern. Each distinct word of a partition is encoded once. Its token positions join the merge
table, the leftmost pair of least rank is contracted, and the query recurs until no pair of a word is in the table. Words of more
than LONG_WORD bytes contract, in one step, every place of their least pair, left to right. That gives the same ids where
merges come in rising rank for every item of the vocabulary, which is checked; elsewhere they too go pair by pair. A stretch
of n bytes without a split costs n rows for each different merge in it.

Decoding joins token positions with the vocabulary and aggregates the items in order. An id that the vocabulary lacks makes
the row's bytes null, as does a null list; a null id in a list too. In `recode`, a word's ids are decoded once and a
document's bytes are those of its words' ids in order.

A null text is empty and has no ids. Repeated or null doc_id are rows of their own. An empty table gives no row. Columns other
than the named ones are not looked at. A text longer than a slice is split into words and encoded in slices.
"""

import base64
import itertools
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import hand_back, slices

#: Bytes of text whose words are looked up together, and of a longer text's part.
SLICE = 2_000_000
SLICE_WORDS = 400_000
#: Distinct words that a task remembers between slices, about 200 bytes each.
REMEMBERED = 1_000_000
#: Bytes of a word that goes pair by pair.
LONG_WORD = 64
#: Rows that one recursive query over long words may gather before it is begun again from where it stands.
GATHERED = 8_000_000
#: A pair of ids is one number; ids of a rank file stay far below.
BASE = 1 << 20

_MERGES = """
CREATE TABLE merges AS
SELECT l.id::BIGINT * {base} + r.id AS pair, v.id AS made
FROM (SELECT id, piece, unnest(range(1, len(piece))) AS cut FROM vocab) v
JOIN vocab l ON l.piece = left(v.piece, v.cut) JOIN vocab r ON r.piece = substr(v.piece, v.cut + 1)"""

#: words(w, ts) to coded(w, ts, rises): rises tells whether ranks of the merges never fell.
_SHORT = """
CREATE OR REPLACE TEMP TABLE coded AS
WITH RECURSIVE state(w, ts, made, rises) AS (
  SELECT w, ts, -1, true FROM words
  UNION ALL
  SELECT s.w, s.ts[:spot - 1] || [best.made] || s.ts[spot + 2:], best.made, s.rises AND best.made >= s.made
  FROM (
    SELECT w, (least % {base})::INTEGER AS spot, (least // {base})::INTEGER AS made FROM (
      SELECT w, min(made::BIGINT * {base} + spot) AS least FROM (
        SELECT w, unnest(list_transform(list_zip(ts[:-2], ts[2:]), lambda x: x[1]::BIGINT * {base} + x[2])) AS pair, generate_subscripts(ts[2:], 1) AS spot
        FROM state WHERE len(ts) > 1
      ) JOIN merges USING (pair) GROUP BY w)
  ) best JOIN state s USING (w)
)
SELECT w, arg_min(ts, len(ts)) AS ts, arg_min(rises, len(ts)) AS rises FROM state GROUP BY w"""

#: rows(w, p, t) to rows of the last step n of each word. {hit} chooses among the places of the least pair.
_LONG = """
WITH RECURSIVE state(n, w, p, t) AS (
  SELECT 0, w, p, t FROM rows
  UNION ALL
  SELECT n + 1, w, row_number() OVER (PARTITION BY w ORDER BY p), t FROM (
    SELECT n, w, p, CASE WHEN hit THEN made ELSE t END AS t, lag(hit, 1, false) OVER (PARTITION BY w ORDER BY p) AS gone FROM (
      SELECT *, fits AND {hit} AS hit FROM (
        SELECT *, p - row_number() OVER (PARTITION BY w, fits ORDER BY p) AS run FROM (
          SELECT *, coalesce(made = least, false) AS fits FROM (
            SELECT n, w, p, t, made, min(made) OVER (PARTITION BY w) AS least FROM (
              SELECT n, w, p, t, t::BIGINT * {base} + lead(t) OVER (PARTITION BY w ORDER BY p) AS pair FROM state WHERE n < {steps}
            ) LEFT JOIN merges USING (pair)
          ) WHERE least IS NOT NULL)))
  ) WHERE NOT gone
)
SELECT n, w, list(t ORDER BY p) AS ts FROM state JOIN (SELECT w, max(n) AS n FROM state GROUP BY w) USING (w, n) GROUP BY n, w"""
_EVERY = "row_number() OVER (PARTITION BY w, fits, run ORDER BY p) % 2 = 1"
_LEFTMOST = "p = min(CASE WHEN fits THEN p END) OVER (PARTITION BY w)"

_DECODE = """
SELECT w, CASE WHEN bool_and(piece IS NOT NULL) THEN string_agg(piece, '' ORDER BY spot) END AS piece
FROM (SELECT w, unnest(ts) AS id, generate_subscripts(ts, 1) AS spot FROM {lists}) LEFT JOIN vocab USING (id) GROUP BY w"""


def ranks_of(path: str) -> dict[bytes, int]:
    """The items of a rank file: base64 and rank, a line each."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines())
    return {base64.b64decode(x[0]): int(x[1]) for x in lines if x}


class Codec:
    """A rank file as tables of a DuckDB in memory. Bytes stand in it as characters 0 to 255."""

    def __init__(self, path: str, threads: int = 1):
        import duckdb

        self.ranks = ranks_of(path)
        if max(self.ranks.values(), default=0) >= BASE or any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a rank file has an item for every byte, and ids below 2**20")
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": threads, "memory_limit": "600MB", "temp_directory": ""})
        items = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "piece": pa.array([k.decode("latin-1") for k in self.ranks])})
        self._run("CREATE TABLE vocab AS SELECT * FROM items", items=items)
        self._run(_MERGES.format(base=BASE))
        self.forget()

    def _run(self, sql: str, **tables: pa.Table):
        for name, table in tables.items():
            self.db.register(name, table)
        got = self.db.sql(sql).to_arrow_table() if sql.lstrip().startswith(("SELECT", "WITH")) else self.db.execute(sql)
        for name in tables:
            self.db.unregister(name)
        return got

    def forget(self) -> None:
        """The words known so far go: place by word; where its ids and bytes stand in the pools."""
        self.known: dict[str, int] = {"": 0}
        self.ids, self.bytes = [np.zeros(0, np.int32)], [np.zeros(0, np.uint8)]
        self.n_ids, self.n_bytes = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]

    @cached_property
    def rising(self) -> bool:
        """Whether each item comes from its bytes by merges of rising rank. Then a merge never makes way for one of lower rank, so
        all places of a word's least pair are contracted before any other pair, in one step or in many."""
        items = list(self.ranks)
        self._run(_SHORT.format(base=BASE), words=self._bytes_table(range(len(items)), items))
        got = self._run("SELECT w, ts, rises FROM coded")
        return all(r and ts == [self.ranks[items[w]]] for w, ts, r in zip(*(got[c].to_pylist() for c in ("w", "ts", "rises"))))

    def _bytes_table(self, numbers, items: list[bytes]) -> pa.Table:
        ends = np.cumsum([0, *map(len, items)])
        flat = self.of_byte[np.frombuffer(b"".join(items), np.uint8)]
        return pa.table({"w": pa.array(numbers, pa.int32()), "ts": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))})

    def encode_words(self, items: list[bytes]) -> pa.Table:
        """w (place in items) and ts (ids) of different words, in no order."""
        whole = [(i, self.ranks[x]) for i, x in enumerate(items) if x in self.ranks]
        rest = [(i, x) for i, x in enumerate(items) if x not in self.ranks]
        short = [(i, x) for i, x in rest if len(x) <= LONG_WORD]
        done = [pa.table({"w": pa.array([i for i, _ in whole], pa.int32()), "ts": pa.array([[t] for _, t in whole], pa.list_(pa.int32()))})]
        if short:
            self._run(_SHORT.format(base=BASE), words=self._bytes_table([i for i, _ in short], [x for _, x in short]))
            done.append(self._run("SELECT w, ts FROM coded"))
        for some in self._batches([(i, x) for i, x in rest if len(x) > LONG_WORD]):
            done.append(self._long(self._bytes_table([i for i, _ in some], [x for _, x in some])))
        kind = pa.schema([("w", pa.int32()), ("ts", pa.list_(pa.int32()))])
        return pa.concat_tables([t.select(["w", "ts"]).cast(kind) for t in done]).combine_chunks()

    @staticmethod
    def _batches(rows: list[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
        for a, b in slices([x for _, x in rows], GATHERED // 64):
            yield rows[a:b]

    def _long(self, lists: pa.Table) -> pa.Table:
        """Long words until none has a pair left: a query of so many steps that what it gathers is bounded, then from there again."""
        hit, done = _EVERY if self.rising else _LEFTMOST, []
        while lists.num_rows:
            size = len(lists["ts"].combine_chunks().flatten())
            steps = max(4, GATHERED // size)
            self._run("CREATE OR REPLACE TEMP TABLE rows AS SELECT w, unnest(ts) AS t, generate_subscripts(ts, 1)::BIGINT AS p FROM lists", lists=lists)
            got = self._run(_LONG.format(base=BASE, hit=hit, steps=steps))
            over = pc.less(got["n"], steps)
            done.append(got.filter(over).select(["w", "ts"]))
            lists = got.filter(pc.invert(over)).select(["w", "ts"])
        return pa.concat_tables(done)

    def decode_lists(self, lists: pa.Table) -> tuple[np.ndarray, list[bytes | None]]:
        """w and the bytes of its ids, in the order of w; lists without an id are left out."""
        got = self._run(_DECODE.format(lists="lists") + " ORDER BY w", lists=lists)
        return got["w"].to_numpy(), [None if x is None else x.encode("latin-1") for x in got["piece"].to_pylist()]

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > REMEMBERED and len(self.known) > 1:
            self.forget()
            new = list(words)
        coded = self.encode_words([w.encode() for w in new]).sort_by("w")
        ts = coded["ts"].combine_chunks()
        _, pieces = self.decode_lists(coded)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.ids.append(ts.flatten().to_numpy())
        self.n_ids.append(ts.value_lengths().to_numpy().astype(np.int64))
        self.bytes.append(np.frombuffer(b"".join(pieces), np.uint8))
        self.n_bytes.append(np.array([len(x) for x in pieces], np.int64))

    def recode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of words in order: all ids, how many each word has, all bytes decoded from them, how many each word has."""
        self.learn(set(words))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        out = []
        for pool, lengths in ((self.ids, self.n_ids), (self.bytes, self.n_bytes)):
            pool[:], lengths[:] = [np.concatenate(pool)], [np.concatenate(lengths)]
            starts = np.cumsum(lengths[0]) - lengths[0]
            n = lengths[0][at]
            ends = np.cumsum(n)
            spots = np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            out += [pool[0][spots], n]
        return tuple(out)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The task's codec of this file. Functions go to tasks by value, each with variables of its own, so it does not outlast the task."""
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _recoded(coder: Codec, pattern, texts: list[str]) -> tuple[pa.Array, pa.Array]:
    """ids (list of int) and decoded (binary) of texts, or of a single text of any length, part by part."""
    if len(texts) == 1:
        found = (m.group() for m in pattern.finditer(texts[0]))
        parts = [coder.recode(some) for some in iter(lambda: list(itertools.islice(found, SLICE_WORDS)), [])]
        ids, data = (np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, kind) for i, kind in ((0, np.int32), (2, np.uint8)))
        starts = [np.array([0, len(x)]) for x in (ids, data)]
    else:
        words = [pattern.findall(t) for t in texts]
        ends = np.cumsum([0, *map(len, words)])
        ids, n_ids, data, n_data = coder.recode(list(itertools.chain.from_iterable(words)))
        starts = [np.concatenate([[0], np.cumsum(n)])[ends] for n in (n_ids, n_data)]
    lists = pa.ListArray.from_arrays(pa.array(starts[0], pa.int32()), pa.array(ids))
    return lists, pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(starts[1].astype(np.int32)), pa.py_buffer(data)])


def recode(docs: DataFrame, path: str, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of each text, and decoded (binary): the bytes that these ids stand for."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN

    def run(batches):
        import regex

        coder, split = codec(path), regex.compile(pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([t.encode() for t in texts], SLICE):
                lists, binary = _recoded(coder, split, texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists, binary], ["doc_id", "ids", "decoded"])
        hand_back()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id], docs[text]).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def encode(docs: DataFrame, path: str, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each text."""
    return recode(docs, path, pattern, doc_id, text).drop("decoded")


def decode(rows: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and decoded (binary) of any lists of ids."""

    def run(batches):
        coder = codec(path)
        for batch in batches:
            lists = batch.column(1).cast(pa.list_(pa.int32()))
            lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy()
            for a, b in slices([range(n) for n in lengths], SLICE_WORDS):
                some = lists[a:b]
                out: list[bytes | None] = [b"" if x else None for x in some.is_valid().to_pylist()]
                w, found = coder.decode_lists(pa.table({"w": pa.array(range(b - a), pa.int32()), "ts": some}))
                for i, x in zip(w, found):
                    out[i] = x
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(out, pa.binary())], ["doc_id", "decoded"])
        hand_back()

    kind = rows.schema[doc_id].dataType.simpleString()
    return rows.select(rows[doc_id], rows[ids]).mapInArrow(run, f"doc_id {kind}, decoded binary")
