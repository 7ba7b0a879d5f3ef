"""N-gram Jaccard join: documents whose sets of word n-grams overlap by a least Jaccard share are linked.

The sets are in one global order, most frequent n-gram first, and stored in prefix trees. A probe walks a tree with the
overlap so far, which all sets below a node share, and leaves a subtree when what remains of the probe and of its
longest set can't reach the overlap that its shortest set needs. Two sets that link share one of the last
n - ceil(share * n) + 1 n-grams of the order; only sets that do are probed against each other.

1. Chunks of documents send these n-grams, once for all their sets, to find those that several sets have. A frequent one
   names the set with the most frequent n-grams as its hub, which is probed against the trees of the chunks that have
   enough of the n-grams it is the hub of. Others only miss a shortcut: their sets meet in the second step.
2. For each shared n-gram, a chunk then names its sets with a parity sketch, and of the sets that link with one hub, if
   they are many, the hub alone. Where sets that are not connected share an n-gram, they are probed: named ones against
   those that the sketch, which never loses a link, allows, all others against all that share it in the other's chunk.
3. Of many candidates that are connected with each other, the nearest are probed first, and the rest only if no link is
   found.

Links are found between classes of equal sets, so a group of equal or of near copies costs in proportion to its size.
Null and empty texts have empty sets and link with nothing; fewer words than an n-gram are one n-gram. Rows stay one to
one, also repeated ones and those with a null doc_id.
"""

from bisect import bisect_left
from functools import wraps
from inspect import signature

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, bucket_of, chunk_rows, chunked, hand_back, in_sorted, joined, mix, runs, slices, unpack, window_hashes, word_hashes, written
from .components import components

WORDS = 4
PERCENT = 85
#: n-grams whose frequency the global order knows, the most frequent ones of the corpus. The order is only faster for it.
RANKED = 1 << 17
#: From so many sets (or chunks) on, an n-gram has a hub.
HUB_FROM = 12
#: A hub goes to the chunks with at least this share of its last n-grams: near copies have most of them, a common phrase few.
HUB_SHARE = 0.5
#: Bytes of text that a task packs at a time.
PACK_BYTES = 32_000_000
#: Linked sets of one chunk and hub that an n-gram names one by one; beyond, it names the hub alone.
LINKED_BY_NAME = 256
#: Sets of one part that a set is probed against at first: those that the sketch finds nearest.
NEAREST = 6
#: Words of sketches, of 8 bytes each, that are compared at a time.
COMPARED = 1 << 20
#: Pairs that are held before those that came several times become one.
PAIRS = 1 << 18
#: Chunks whose shared n-grams meet in one task of the second step.
CHUNKS_A_BUCKET = 8
#: Names of documents, of about 40 bytes each, that are broadcast at most.
BROADCAST_ROWS = 200_000
#: Rows of a chunk are numbered below this.
SPAN = 1 << 32


def shingle_sets(texts: list[bytes], k: int):
    """Row and ascending distinct n-gram hashes of each text with words."""
    for a, b in slices(texts):
        parts = [t.lower().split() for t in texts[a:b]]
        hashes = word_hashes([w for p in parts for w in p])
        at = 0
        for i, p in enumerate(parts):
            if p:
                yield a + i, np.unique(window_hashes(hashes[at : at + len(p)], min(k, len(p))))
            at += len(p)


def needed(n, m, percent: int = PERCENT):
    """The least overlap with which sets of n and m link: 100 * overlap >= percent * (n + m - overlap)."""
    return -(-percent * (n + m) // (100 + percent))


def signature_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


class Order:
    """The global order: n-grams by falling frequency (0 outside the ranked ones), then by hash. hashes ascend."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.hashes, self.counts = hashes, counts

    def sort(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ascending set in order, and the frequencies."""
        counts = np.zeros(len(shingles), np.uint32)
        if not len(self.hashes):
            return shingles, counts
        at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
        hit = self.hashes[at] == shingles
        often = np.flatnonzero(hit)
        if not len(often):
            return shingles, counts
        # The others stand by hash already.
        n, h = self.counts[at[often]], shingles[often]
        order = np.lexsort((h, ~n))
        counts[: len(often)] = n[order]
        return np.concatenate((h[order], shingles[~hit])), counts

    def key(self, ordered: np.ndarray, counts: np.ndarray) -> bytes:
        """Bytes that compare as the ordered sets do."""
        out = np.empty((len(ordered), 12), np.uint8)
        out[:, :4] = (~counts).astype(">u4").view(np.uint8).reshape(-1, 4)
        out[:, 4:] = ordered.astype(">u8").view(np.uint8).reshape(-1, 8)
        return out.tobytes()


class PrefixTree:
    """Ordered sets as a tree with one node for each stretch that the same sets share."""

    def __init__(self, sets: list[np.ndarray], keys: list[bytes]):
        self.at = sorted(range(len(sets)), key=keys.__getitem__)
        self.place = {row: i for i, row in enumerate(self.at)}
        self.sets = [sets[i] for i in self.at]
        self.shared = [self._common(a, b) for a, b in zip(self.sets, self.sets[1:])]
        self.root = self._node(0, len(sets), 0) if sets else None

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _node(self, low: int, high: int, start: int) -> list:
        """low, high, start, end, shortest, longest and children, the last of which are made when first visited."""
        end = min(self.shared[low : high - 1], default=len(self.sets[low]))
        sizes = [len(s) for s in self.sets[low:high]]
        return [low, high, start, end, min(sizes), max(sizes), None]

    def _children(self, node: list) -> list[list]:
        low, high, _, end, _, _, children = node
        if children is None:
            children = node[6] = []
            while low < high:
                stop = low + 1
                while stop < high and self.shared[stop - 1] > end:
                    stop += 1
                if len(self.sets[low]) > end:
                    children.append(self._node(low, stop, end))
                low = stop
        return children

    def probe(self, probe: np.ndarray, wanted: list[int], percent: int = PERCENT) -> list[int]:
        """Which of the wanted sets (their numbers at first) link with the ordered probe."""
        if self.root is None or not wanted:
            return []
        n, found = len(probe), []
        places = sorted(self.place[i] for i in wanted)
        by_hash = np.argsort(probe)
        ascending = probe[by_hash]
        todo = [(self.root, 0, 0)]
        while todo:
            node, overlap, passed = todo.pop()
            low, high, start, end, shortest, longest, _ = node
            first = bisect_left(places, low)
            if first == len(places) or places[first] >= high:
                continue
            stretch = self.sets[low][start:end]
            if len(stretch):
                at = np.minimum(np.searchsorted(ascending, stretch), n - 1)
                hit = ascending[at] == stretch
                if count := int(np.count_nonzero(hit)):
                    overlap, passed = overlap + count, int(by_hash[at[hit]].max()) + 1
            if overlap + min(n - passed, longest - end) < needed(n, shortest, percent):
                continue
            # Sets that end here are in front of the longer ones.
            for p in places[first:]:
                if p >= high or len(self.sets[p]) > end:
                    break
                if overlap >= needed(n, len(self.sets[p]), percent):
                    found.append(self.at[p])
            todo += [(c, overlap, passed) for c in self._children(node)]
        return found


def sketch_bits(n: int) -> int:
    """A power of two from twice the set's size on."""
    return max(64, 1 << (2 * n - 1).bit_length())


def sketch_widths(sizes: np.ndarray) -> np.ndarray:
    """Bytes of the sketches of sets of these sizes."""
    distinct, of = np.unique(sizes, return_inverse=True)
    return np.array([sketch_bits(n) // 8 for n in distinct.tolist()], np.int64)[of]


def sketch(shingles: np.ndarray) -> bytes:
    """Parity of the n-grams that fall on each bit."""
    size = sketch_bits(len(shingles))
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketched:
    """Sets that may have to be compared: their places, parts (what they are connected with), sizes and sketches."""

    def __init__(self):
        self.nodes, self.parts, self.sizes, self.buffers, self.at, self.n = [], [], [], [], [], 0

    def add(self, nodes: np.ndarray, parts: np.ndarray, sizes: np.ndarray, sketches: pa.Buffer | bytes) -> None:
        """Sets whose sketches stand behind each other in a buffer, which is kept as it is."""
        widths = sketch_widths(sizes)
        of = np.full(len(nodes), len(self.buffers), np.int64)
        self.buffers.append(memoryview(sketches))
        for held, x in ((self.nodes, nodes), (self.parts, parts), (self.sizes, sizes), (self.at, np.stack([of, np.cumsum(widths) - widths], axis=1))):
            held.append(x)
        self.n += len(nodes)

    def close(self) -> None:
        self.nodes, self.parts, self.sizes = (joined(x, np.int64) for x in (self.nodes, self.parts, self.sizes))
        self.at = np.concatenate(self.at) if self.at else np.zeros((0, 2), np.int64)
        self.widths = sketch_widths(self.sizes) // 8

    def hold(self, rows: np.ndarray) -> None:
        """Takes the sketches of the sets that are going to be compared out of the buffers."""
        self.spot, self.held = np.full(self.n, -1, np.int64), {}
        for own in np.unique(self.widths[rows]).tolist():
            some = rows[self.widths[rows] == own]
            self.spot[some] = np.arange(len(some))
            self.held[own] = np.frombuffer(b"".join(self.buffers[i][at : at + own * 8] for i, at in self.at[some].tolist()), np.uint64).reshape(len(some), -1)

    def matrix(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Sketches of one width, folded to a smaller one."""
        m = self.held[int(self.widths[rows[0]])][self.spot[rows]]
        while m.shape[1] > width:
            m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
        return m

    def pairs(self, rows: np.ndarray, percent: int):
        """Pairs of different parts that can link, and how far apart they are at least: two sets differ in at least as many n-grams as their sketches in bits.

        All but the largest part's sets are held against all sets, so a group that is mostly connected costs little."""
        parts, count = np.unique(self.parts[rows], return_counts=True)
        few = rows[self.parts[rows] != parts[count.argmax()]]
        is_few = np.isin(rows, few)
        for own in np.unique(self.widths[few]):
            a = few[self.widths[few] == own]
            # A linked set is at most as much larger or smaller as the share allows: sketches twice or half as wide.
            for other in (own // 2, own, own * 2):
                right_rows = self.widths[rows] == other
                b, b_few = rows[right_rows], is_few[right_rows]
                if not len(b):
                    continue
                width = int(min(own, other))
                left, right = self.matrix(a, width), self.matrix(b, width)
                step = max(1, min(64, COMPARED // (len(b) * width)))
                for at in range(0, len(a), step):
                    some = a[at : at + step]
                    n, m = self.sizes[some][:, None], self.sizes[b][None, :]
                    fits = (self.parts[some][:, None] != self.parts[b][None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                    fits &= ~b_few[None, :] | (some[:, None] < b[None, :])  # of two that are few, once
                    x, y = np.nonzero(fits)
                    apart = np.bitwise_count(left[at + x] ^ right[y]).sum(axis=1, dtype=np.int64)
                    n, m = self.sizes[some[x]], self.sizes[b[y]]
                    good = (n + m - apart) // 2 >= needed(n, m, percent)
                    yield some[x[good]], b[y[good]], (apart / (n + m))[good]


def ranked(docs: DataFrame, k: int, keep: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams of all texts and their counts: at most `keep` rows come to the driver."""

    def count(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for a, b in slices(texts, CHUNK_BYTES):
                hashes, n = np.unique(joined([s for _, s in shingle_sets(texts[a:b], k)], np.uint64), return_counts=True)
                often = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(hashes[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["h", "n"])
        hand_back()

    counts = docs.select(docs[text]).mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "h").limit(keep).toArrow()
    hashes, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    by = np.argsort(hashes)
    return hashes[by], np.minimum(n[by], 2**32 - 1).astype(np.uint32)


def planes(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones and so on: zeros stand together, which shuffles as next to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def packed(rows: DataFrame) -> DataFrame:
    """chunk, size and block: the rows of `chunked`, those of one chunk and task as one compressed block, for the shuffle."""

    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("chunk")
        chunk = table.column("chunk").to_numpy()
        out = []
        for a, b in zip(*runs(chunk)):
            sink = pa.BufferOutputStream()
            part = table.slice(a, b - a).select(["doc_id", "text"]).combine_chunks()
            with pa.ipc.new_stream(sink, part.schema) as writer:
                writer.write_table(part)
            data = sink.getvalue()
            out.append((int(chunk[a]), data.size, pa.Codec("zstd").compress(data, asbytes=True)))
        return pa.RecordBatch.from_pylist([dict(zip(("chunk", "size", "block"), x)) for x in out], pa.schema([("chunk", pa.int32()), ("size", pa.int64()), ("block", pa.binary())]))

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= PACK_BYTES:
                yield blocks(held)
                held, size = [], 0
        if held:
            yield blocks(held)
        hand_back()

    return rows.mapInArrow(pack, "chunk int, size bigint, block binary")


def unpacked(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """What chunk_rows gives, of a chunk's blocks."""
    codec = pa.Codec("zstd")
    parts = [pa.ipc.open_stream(codec.decompress(block.as_buffer(), n)).read_all() for block, n in zip(table.column("block"), table.column("size").to_pylist())]
    return chunk_rows(pa.concat_tables(parts)) if parts else ([], [])


_SENT = "bucket int, chunk int, hashes binary, rows binary, counts binary, scores binary"
_ASKED = "chunk int, hashes binary, row bigint, target int, wanted binary"
_SHIPPED = "chunk int, hashes binary, hub bigint, shingles binary, wanted binary, later int"
_FOUND = "bucket int, chunk int, kind int, node bigint, other bigint, doc_id bigint, n bigint, text_key bigint, hashes binary, rows binary, sizes binary, sketches binary, hubs binary"
_KEPT = "kind int, node bigint, other bigint, doc_id bigint, n bigint, text_key bigint, more binary"
DOCUMENT, LINK, NAMED, LINKED, LATER = range(5)
#: In place of a target: what is wanted are pairs put off, sets named by their nodes, or chunks and how many n-grams ask for each.
PUT_OFF, NODES, COUNTED = -1, -2, -3
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else ((),) * len(fields)
    return pa.table({name: pa.array(list(c), _ARROW[kind]) for (name, kind), c in zip(fields, columns)})


def _asks(asked: dict[tuple[int, int], set[int] | None]) -> list[tuple]:
    """Rows of _ASKED that have a node's set sent to chunks, for some rows there or (None) for all: at most two a node."""
    chunks: dict[int, list[int]] = {}
    nodes: dict[int, list[int]] = {}
    for (node, chunk), rows in sorted(asked.items(), key=lambda x: x[0]):
        if rows is None:
            chunks.setdefault(node, []).append(chunk)
        else:
            nodes.setdefault(node, []).extend(chunk * SPAN + i for i in sorted(rows))
    out = [(a // SPAN, None, a % SPAN, None, np.array(to, np.int32).tobytes()) for a, to in chunks.items()]
    return out + [(a // SPAN, None, a % SPAN, NODES, np.array(to, np.int64).tobytes()) for a, to in nodes.items()]


def join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, hub_from: int = HUB_FROM) -> DataFrame:
    """doc_id (long), n_shingles, component_id: the smallest doc_id that links reach from the document."""
    rows = placed(docs, k, percent, doc_id, text, chunk_bytes, hub_from)
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which one of each group of linked ones stays: the one with the smallest doc_id
    (null last), then the smallest hash of its text; of rows that are alike in both, any one. Rows with no words all stay.

    Rows are named by their id and the hash of their text, so another text of the same id is not touched."""
    rows = placed(docs, k, percent, doc_id, text).filter("n_shingles > 0")
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_key").alias("key"))
    named = written(rows.select("root", name.alias("name")).groupBy("root", "name").agg(F.count("*").alias("n")), "ngram-names")
    first = named.groupBy("root").agg(F.min("name").alias("first"))
    # Most rows stay as they are: only the others' names are looked for among the documents.
    others = named.join(first, "root").select("name.*", (F.col("name") == F.col("first")).alias("stays"), "n").filter("not stays or n > 1")
    others = written(others.select("none", "id", "key", "stays"), "ngram-decisions")
    if others.count() <= BROADCAST_ROWS:
        others = F.broadcast(others)
    own = {"_none": docs[doc_id].isNull(), "_id": F.coalesce(docs[doc_id].cast("long"), F.lit(0)), "_key": F.xxhash64(docs[text])}
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in own.items()))
    same = (F.col("_none") == F.col("none")) & (F.col("_id") == F.col("id")) & (F.col("_key") == F.col("key"))
    judged = whole.join(others, same, "left")
    again = judged.filter("stays").dropDuplicates(["_none", "_id", "_key"])
    return judged.filter("stays is null").select("row.*").unionByName(again.select("row.*"))


def placed(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, hub_from: int = HUB_FROM) -> DataFrame:
    """doc_id (long), text_key (xxhash64 of the text), n_shingles and root, equal for the rows that links connect; a row for each of docs."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(ranked(docs, k, RANKED, text))
    rows, n = chunked(docs, doc_id, text, chunk_bytes)
    rows, buckets = packed(rows), -(-n // CHUNKS_A_BUCKET)

    def tail(s: np.ndarray) -> np.ndarray:
        return s[-signature_size(len(s), percent) :]

    def classes(table: pa.Table):
        """Ids, texts, the row that each row's set is first seen in (-1: empty), sizes, and these rows' sets in order."""
        ids, texts = unpacked(table)
        seen, first, sizes, sets, ordering = {}, np.full(len(texts), -1, np.int64), np.zeros(len(texts), np.int64), {}, Order(*order.value)
        for i, s in shingle_sets(texts, k):
            first[i], sizes[i] = seen.setdefault(s.tobytes(), i), len(s)
            if first[i] == i:
                sets[i] = ordering.sort(s)
        return ids, texts, first, sizes, sets, ordering

    def links(base: int, sets: dict, ordering: Order, tails: dict[int, np.ndarray], probes) -> list[tuple[int, int]]:
        """(hub, node) for each probe (hub, its set, the rows to try: None for all) and set of the chunk that link."""
        names = list(tails)
        flat = joined([tails[i] for i in names], np.uint64)
        of = np.repeat(np.array(names, np.int64), [len(tails[i]) for i in names])
        by = np.argsort(flat, kind="stable")
        flat, of = flat[by], of[by]
        wanted = []
        for hub, s, only in probes:
            spans = zip(np.searchsorted(flat, tail(s)), np.searchsorted(flat, tail(s), side="right"))
            near = np.unique(joined([of[a:b] for a, b in spans if b > a], np.int64))
            near = near if only is None else near[np.isin(near, only)]
            wanted.append([i for i in near.tolist() if base + i != hub])
        at = sorted({i for w in wanted for i in w})
        place = {i: j for j, i in enumerate(at)}
        tree = PrefixTree([sets[i][0] for i in at], [ordering.key(*sets[i]) for i in at])
        return [(hub, base + at[j]) for (hub, s, _), w in zip(probes, wanted) for j in tree.probe(s, [place[i] for i in w], percent)]

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, _, _, _, sets, _ = classes(table)
        tails = [(i, tail(s), float(c.sum()) / len(s)) for i, (s, c) in sets.items()]
        lengths = [len(t) for _, t, _ in tails]
        hashes = joined([t for _, t, _ in tails], np.uint64)
        row = np.repeat(np.array([i for i, _, _ in tails], np.uint32), lengths)
        score = np.repeat(np.array([x for _, _, x in tails], np.float32), lengths)
        by = np.lexsort((row, -score, hashes))  # the most central set of each n-gram first
        hashes, row, score = hashes[by], row[by], score[by]
        starts, ends = runs(hashes)
        hashes, row, score, count = hashes[starts], row[starts], score[starts], np.minimum(ends - starts, 255).astype(np.uint8)
        bucket = bucket_of(mix(hashes), n)  # mixed anew: the last n-grams of a set have high hashes
        by = np.argsort(bucket, kind="stable")
        hashes, row, score, count, bucket = hashes[by], row[by], score[by], count[by], bucket[by]
        score = (score.view(np.uint32) >> np.uint32(16)).astype(np.uint16)  # none is negative, so the upper half of the bits is in order
        return _table([(int(bucket[a]), key[0].as_py(), hashes[a:b].tobytes(), *(planes(x[a:b]) for x in (row, count, score))) for a, b in zip(*runs(bucket))], _SENT)

    def meet(table: pa.Table) -> pa.Table:
        """To each chunk, its n-grams that other sets have too; to the chunk of a hub, where to send it."""
        parts = unpack(table, "hashes", np.uint64)
        names = table.column("chunk").to_numpy().astype(np.int64)
        hashes, chunk = joined(parts, np.uint64), np.repeat(names, [len(p) for p in parts])
        row, count, score = (joined([from_planes(x, d) for x in table.column(c).to_pylist()], d) for c, d in (("rows", np.uint32), ("counts", np.uint8), ("scores", np.uint16)))
        # Equal sets score alike: which of their chunks has the hub differs from score to score, not from n-gram to n-gram.
        lot = mix(chunk.astype(np.uint64) | score.astype(np.uint64) << np.uint64(32))
        by = np.lexsort((row, lot, ~score, hashes))
        starts, ends = runs(hashes[by])
        sums = np.add.reduceat(count[by].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        several = np.zeros(len(hashes), bool)
        several[by] = np.repeat(sums > 1, ends - starts)
        often = sums >= hub_from
        first, lengths = by[starts[often]], (ends - starts)[often]
        hub = np.repeat(chunk[first] * SPAN + row[first], lengths)
        to = chunk[by[np.repeat(often, ends - starts)]]
        order = np.lexsort((to, hub))
        hub, to = hub[order], to[order]
        at = np.flatnonzero(np.concatenate(([True], (hub[1:] != hub[:-1]) | (to[1:] != to[:-1])))) if len(hub) else np.zeros(0, np.int64)
        hub, pairs = hub[at], np.stack([to[at], np.diff(np.append(at, len(order)))], axis=1).astype(np.int32)
        asks = [(int(hub[a] // SPAN), None, int(hub[a] % SPAN), COUNTED, pairs[a:b].tobytes()) for a, b in zip(*runs(hub))]
        cut = np.cumsum([0, *map(len, parts)])
        out = [(int(c), p[several[a:b]].tobytes(), None, None, None) for c, p, a, b in zip(names, parts, cut, cut[1:]) if several[a:b].any()]
        return _table(out + asks, _ASKED)

    def ship(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        """Sets that other chunks asked for: by row for chunks (target null) or nodes, or (row null) all with an n-gram for a target; the chunk's own shared n-grams (both null)."""
        chunk, ordering = key[0].as_py(), Order(*order.value)
        asked: dict[tuple[int, int], set[int] | None] = {}
        shared: dict[int, set[int]] = {}
        counted: dict[int, list[bytes]] = {}
        out = []
        for h, r, t, w in zip(*(right.column(c).to_pylist() for c in ("hashes", "row", "target", "wanted"))):
            if t is None and r is None:
                out.append((chunk, h, None, None, None, 0))
            elif t is None:
                asked.update(((r, x), None) for x in np.frombuffer(w, np.int32).tolist())
            elif t == COUNTED:
                counted.setdefault(r, []).append(w)
            elif t == PUT_OFF:
                out.append((chunk, None, r, h, w, 1))
            elif t == NODES:
                for x in np.frombuffer(w, np.int64).tolist():
                    if asked.get((r, x // SPAN), ()) is not None:
                        asked.setdefault((r, x // SPAN), set()).add(x % SPAN)
            else:
                for x in np.frombuffer(h, np.uint64).tolist():
                    shared.setdefault(x, set()).add(t)
        texts = unpacked(left)[1] if asked or shared or counted else []
        at = range(len(texts)) if shared else sorted({r for r, _ in asked} | set(counted))
        targets: dict[int, list[int]] = {}
        for r, t in sorted(asked):
            targets.setdefault(r, []).append(t)
        some = np.array(sorted(shared), np.uint64)
        for i, s in shingle_sets([texts[r] for r in at], k):
            s, r = ordering.sort(s)[0], at[i]
            last = tail(s)
            extra = {t for h in last[in_sorted(last, some)].tolist() for t in shared[h]}
            if r in counted:
                to, times = np.frombuffer(b"".join(counted[r]), np.int32).reshape(-1, 2).T
                extra.update(np.flatnonzero(np.bincount(to, times) >= HUB_SHARE * len(last)).tolist())
            for t in extra | set(targets.get(r, ())):
                rows_there = None if t in extra else asked[r, t]
                out.append((t, None, chunk * SPAN + r, s.tobytes(), None if rows_there is None else np.array(sorted(rows_there), np.uint32).tobytes(), 0))
        return _table(out, _SHIPPED)

    def probes_of(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray | None]]:
        found = zip(*(table.column(c).to_pylist() for c in ("hub", "shingles", "wanted", "later")))
        return [(h, np.frombuffer(s, np.uint64), None if w is None else np.frombuffer(w, np.uint32)) for h, s, w, x in found if h is not None and not x]

    def verify(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        base = chunk * SPAN
        ids, texts, first, sizes, sets, ordering = classes(left)
        known = np.unique(joined([np.frombuffer(h, np.uint64) for h in right.column("hashes").to_pylist() if h is not None], np.uint64))
        tails = {i: t for i, (s, _) in sets.items() if len(t := (x := tail(s))[in_sorted(x, known)])}
        none = (None,) * 5
        keys = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64).tolist()  # what xxhash64() gives
        out = [(chunk % buckets, chunk, DOCUMENT, base + i, base + int(first[i]) if first[i] >= 0 else None, ids[i], int(sizes[i]), keys[i], *none) for i in range(len(ids))]
        pairs = links(base, sets, ordering, tails, probes_of(right))
        out += [(chunk % buckets, chunk, LINK, a, b, None, None, None, *none) for a, b in pairs]
        hub_of = {hub: hub for hub, _, _ in probes_of(right) if hub // SPAN == chunk}
        for hub, node in pairs:
            for x in (node, hub):
                hub_of[x] = min(hub, hub_of.get(x, hub))
        hashes = joined(list(tails.values()), np.uint64)
        row = np.repeat(np.array(list(tails), np.int64), [len(t) for t in tails.values()])
        hub = np.array([hub_of.get(base + i, -1) for i in tails], np.int64).repeat([len(t) for t in tails.values()])
        by = np.lexsort((row, hub, hashes))
        hashes, row, hub = hashes[by], row[by], hub[by]
        # Sets that link with one hub are named one by one up to a number.
        start = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (hub[1:] != hub[:-1]))) if len(hashes) else np.zeros(0, bool))
        count = np.diff(np.append(start, len(hashes)))
        many = np.repeat((count > LINKED_BY_NAME) & (hub[start] >= 0), count)
        bits = {i: sketch(sets[i][0]) for i in np.unique(row[~many]).tolist()}
        # By ranges of the hash: few buckets a set, as each of them gets its sketch.
        bucket = bucket_of(hashes, buckets)
        for a, b in zip(*runs(bucket)):
            h, r = hashes[a:b][~many[a:b]], row[a:b][~many[a:b]]
            once = np.unique(r).tolist()
            if once:
                about = planes(np.array([(i, len(sets[i][0]), hub_of.get(base + i, -1)) for i in once], np.int64).ravel())
                out.append((int(bucket[a]), chunk, NAMED, None, None, None, None, None, h.tobytes(), planes(r.astype(np.uint32)), about, b"".join(bits[i] for i in once), None))
            if many[a:b].any():
                both = np.unique(np.stack([hashes[a:b][many[a:b]], hub[a:b][many[a:b]].astype(np.uint64)], axis=1), axis=0)
                out.append((int(bucket[a]), chunk, LINKED, None, None, None, None, None, both[:, 0].tobytes(), None, None, None, both[:, 1].astype(np.int64).tobytes()))
        return _table(out, _FOUND)

    def compare(table: pa.Table) -> pa.Table:
        """Which sets have to be probed where, so that all that share an n-gram are connected or compared."""
        known, flat, of = Sketched(), [], []
        where: dict[int, list[tuple[int, int]]] = {}
        # Row by row from Arrow's own memory, as most of a bucket is sketches that are never looked at.
        columns = [table.column(c) for c in ("chunk", "hashes", "rows", "sizes", "sketches", "hubs")]
        kinds = table.column("kind").to_numpy()
        for i in np.flatnonzero((kinds == NAMED) | (kinds == LINKED)).tolist():
            chunk, h, r, about, sk, hubs = (c[i] for c in columns)
            chunk = chunk.as_py()
            if kinds[i] == NAMED:
                row, size, hub = from_planes(about.as_buffer(), np.int64).reshape(-1, 3).T
                # The rows that a chunk names are in order.
                of.append((known.n + np.searchsorted(row, from_planes(r.as_buffer(), np.uint32).astype(np.int64))).astype(np.int32))
                flat.append(np.frombuffer(h.as_buffer(), np.uint64))
                known.add(chunk * SPAN + row, np.where(hub >= 0, hub, chunk * SPAN + row), size, sk.as_buffer())
            else:
                for x, hub in zip(np.frombuffer(h.as_buffer(), np.uint64).tolist(), np.frombuffer(hubs.as_buffer(), np.int64).tolist()):
                    where.setdefault(x, []).append((hub, chunk))
        known.close()
        flat, of = joined(flat, np.uint64), joined(of, np.int32)
        by = np.lexsort((of, flat))
        flat, of = flat[by], of[by]
        del by
        starts, ends = runs(flat)
        flat = flat[starts]
        mixed = np.zeros(len(starts), bool)
        if len(starts):
            parts = known.parts[of]
            mixed = np.minimum.reduceat(parts, starts) != np.maximum.reduceat(parts, starts)
            del parts
        asked: dict[tuple[int, int], set[int] | None] = {}
        whole: dict[tuple[int, int], set[int]] = {}
        if where:
            for x, a, b in zip(flat.tolist(), starts.tolist(), ends.tolist()):
                for hub, chunk in where.get(x, ()):
                    group = of[a:b]
                    asked.update(dict.fromkeys(((node, chunk) for node in known.nodes[group[known.parts[group] != hub]].tolist()), None))
        # Many n-grams are shared by the same sets: these are compared once. Two sums of hashes tell groups apart, so no group is kept.
        starts, ends = starts[mixed], ends[mixed]
        own = mix(np.arange(known.n, dtype=np.uint64) + np.uint64(1))
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x[of])]) for x in (own, mix(own ^ np.uint64(0x9E3779B97F4A7C15)))]
        names = np.stack([*(x[ends] - x[starts] for x in sums), (ends - starts).astype(np.uint64)], axis=1)
        del sums
        once = np.sort(np.unique(names, axis=0, return_index=True)[1])
        starts, ends = starts[once], ends[once]
        del names, once
        near, held, most = [], 0, PAIRS

        def distinct(near: list) -> tuple[np.ndarray, ...]:
            left, right, apart = (np.concatenate([x[k] for x in near]) if near else np.zeros(0, np.int64) for k in range(3))
            once = np.unique(left.astype(np.int64) * known.n + right, return_index=True)[1]
            return left[once], right[once], apart[once]

        compared = np.zeros(known.n, bool)
        for a, b in zip(starts.tolist(), ends.tolist()):
            compared[of[a:b]] = True
        known.hold(np.flatnonzero(compared))
        for a, b in zip(starts.tolist(), ends.tolist()):
            for pairs in known.pairs(of[a:b], percent):
                near.append(pairs)
                held += len(pairs[0])
                # Two sets may meet in several groups.
                if held > most:
                    near = [distinct(near)]
                    held = len(near[0][0])
                    most = max(PAIRS, 2 * held)
        left, right, apart = distinct(near)
        by = np.lexsort((right, apart, known.parts[right], left))
        left, right = left[by], right[by]
        first = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (known.parts[right[1:]] != known.parts[right[:-1]])))) if len(left) else np.zeros(0, np.int64)
        # The nearest of each part are probed; the others only if that leaves the two unconnected.
        later = []
        for a, b in zip(first, np.append(first[1:], len(left))):
            node = int(known.nodes[left[a]])
            for other in known.nodes[right[a : min(b, a + NEAREST)]].tolist():
                to = node, other // SPAN
                if asked.get(to, ()) is not None:
                    asked.setdefault(to, set()).add(other % SPAN)
            if b > a + NEAREST:
                others = known.nodes[right[a + NEAREST : b]]
                later.append((node // SPAN, np.array([known.parts[right[a]]], np.int64).tobytes(), node, PUT_OFF, others.tobytes()))
        for h, places in where.items():
            hubs = sorted({hub for hub, _ in places})
            for hub, chunk in places:
                whole_to = {c for other, c in places if other > hub}
                if len(hubs) > 1 and whole_to:
                    for c in whole_to:
                        whole.setdefault((chunk, c), set()).add(h)
        out = _asks(asked)
        out += [(chunk, np.array(sorted(hs), np.uint64).tobytes(), None, c, None) for (chunk, c), hs in whole.items()]
        return _table(out + later, _ASKED)

    def probe(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        base, probes = key[0].as_py() * SPAN, probes_of(right)
        found = []
        if probes:
            texts, ordering = unpacked(left)[1], Order(*order.value)
            at = range(len(texts)) if any(w is None for _, _, w in probes) else sorted({int(i) for _, _, w in probes for i in w})
            sets = {at[i]: ordering.sort(s) for i, s in shingle_sets([texts[r] for r in at], k)}
            found = links(base, sets, ordering, {i: tail(s) for i, (s, _) in sets.items()}, probes)
        later = [(LATER, h, int(np.frombuffer(s, np.int64)[0]), None, None, None, w) for h, s, w, x in zip(*(right.column(c).to_pylist() for c in ("hub", "shingles", "wanted", "later"))) if x]
        return _table([(LINK, a, b, None, None, None, None) for a, b in found] + later, _KEPT)

    def passed(table: pa.Table) -> pa.Table:
        kept = table.filter(pc.field("kind") <= LINK).select(["kind", "node", "other", "doc_id", "n", "text_key"])
        return kept.append_column("more", pa.nulls(kept.num_rows, pa.binary()))

    def asked_later(table: pa.Table) -> pa.Table:
        out: dict[tuple[int, int], set[int]] = {}
        for node, more in zip(table.column("node").to_pylist(), table.column("more").to_pylist()):
            for other in np.frombuffer(more, np.int64).tolist():
                out.setdefault((node, other // SPAN), set()).add(other % SPAN)
        return _table(_asks(out), _ASKED)

    def held_for_one_chunk(f):
        """f, which gives back what it has used: a worker holds one chunk at a time, of whatever step."""

        @wraps(f)
        def run(*tables):
            out = f(*tables)
            hand_back()
            return out

        run.__signature__ = signature(f)  # Spark looks at it to tell whether the key is asked for
        return run

    send, ship, verify, compare, probe = map(held_for_one_chunk, (send, ship, verify, compare, probe))
    by_chunk = rows.groupBy("chunk")
    asked = by_chunk.applyInArrow(send, _SENT).groupBy("bucket").applyInArrow(meet, _ASKED)
    shipped = by_chunk.cogroup(asked.groupBy("chunk")).applyInArrow(ship, _SHIPPED)
    found = by_chunk.cogroup(shipped.groupBy("chunk")).applyInArrow(verify, _FOUND).groupBy("bucket")
    more = by_chunk.cogroup(found.applyInArrow(compare, _ASKED).groupBy("chunk")).applyInArrow(ship, _SHIPPED)
    more = by_chunk.cogroup(more.groupBy("chunk")).applyInArrow(probe, _KEPT)
    kept = written(found.applyInArrow(passed, _KEPT).unionByName(more), "ngram-links")
    links_found = kept.filter(F.col("kind") == LINK).select("node", "other")
    whole = components(links_found)
    # What was put off is still needed where the two are in different components.
    late = kept.filter(F.col("kind") == LATER).join(whole.withColumnRenamed("component", "a"), "node", "left")
    late = late.join(whole.select(F.col("node").alias("other"), F.col("component").alias("b")), "other", "left").filter(F.coalesce("a", "node") != F.coalesce("b", "other"))
    late = written(late.select("node", "more"), "ngram-later")
    if not late.isEmpty():
        again = late.groupBy(F.pmod(F.xxhash64("node"), F.lit(n)).alias("k")).applyInArrow(asked_later, _ASKED)
        again = by_chunk.cogroup(again.groupBy("chunk")).applyInArrow(ship, _SHIPPED)
        again = by_chunk.cogroup(again.groupBy("chunk")).applyInArrow(probe, _KEPT).select("node", "other")
        whole = components(written(links_found.unionByName(again), "ngram-links"))
    own = kept.filter(F.col("kind") == DOCUMENT).select("doc_id", "text_key", "n", F.coalesce("other", "node").alias("class"))
    return own.join(whole.withColumnRenamed("node", "class"), "class", "left").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component", "class").alias("root"))
