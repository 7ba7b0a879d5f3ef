"""Words of running text by a lattice over a lexicon, with classes and places.

A lexicon is a table: surface, pos_major, pos_sub, cost (a whole number); a table of costs between classes may stand beside it. All
words that begin at a place, and unknown ones (the run of one kind of character, and its first character alone), are edges; the
cheapest path wins, of equal ones that of fewer words, then that whose last words begin earliest. White space breaks the lattice:
a stretch of it is a token of class "space", and what stands between is analysed once in a task however often it comes.

A text takes time in proportion to its length times the words that begin at a place. Null texts have no tokens; texts without a
known word are runs of unknown ones. The lexicon goes to all tasks, so its size is checked.
"""

import re
import unicodedata
from collections import Counter
from itertools import chain, islice
from sys import intern

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import SENTENCE_END  # the pattern alone goes to the tasks, not its module
from ..storage import spread
from .terms import _islands, _mixed, _Windows, candidate_frequency

#: Entries of a lexicon at most: about 200 bytes each in every task.
MOST_ENTRIES = 2_000_000
#: Cost of an unknown word, and of each of its characters.
UNKNOWN, UNKNOWN_CHARACTER = 1500, 300
#: Characters of stretches between white space that a task remembers, and of the longest such stretch.
REMEMBERED, STRETCH = 1_000_000, 64
#: Rows that a task hands on together, and characters of the texts that it takes apart at once.
ROWS, CHARACTERS = 20_000, 200_000
#: Characters of texts whose different stretches a task analyses at once, and places by classes of the stretches that are held together.
TOGETHER, STATES = 2_000_000, 2_000_000
#: Classes whose words carry meaning (X2), and those whose runs are compounds.
CONTENT, COMPOUND = ("noun", "verb", "adjective", "adjectival"), ("noun", "prefix")
TOKEN = "sent_id bigint, pos bigint, surface string, pos_major string, pos_sub string, known boolean, start bigint, end bigint"
_SPACE = re.compile(r"(\s+)")


def kind(c: str) -> str:
    """digit, latin, kanji, kana (hiragana), katakana, letter (of another script) or symbol."""
    if c.isdigit():
        return "digit"
    name = unicodedata.name(c, "")
    for start, found in (("LATIN", "latin"), ("CJK", "kanji"), ("HIRAGANA", "kana"), ("KATAKANA", "katakana")):
        if name.startswith(start):
            return found
    return "letter" if c.isalpha() else "symbol"


#: Class of an unknown word by its kind of character; the second is the finer class.
OF_KIND = {"digit": ("noun", "number"), "symbol": ("symbol", "general"), "kana": ("particle", "general")}


def words_of(entries) -> dict[str, tuple]:
    """By surface: (pos_major, pos_sub, cost) of each of its entries, each class one string however many words have it."""
    words: dict[str, tuple] = {}
    for surface, major, sub, cost in entries:
        if surface:
            words[surface] = (*words.get(surface, ()), (major and intern(major), sub and intern(sub), int(cost)))
    return words


class Analyser:
    """Cheapest paths. entries: (surface, pos_major, pos_sub, cost), or what words_of() makes of them; links: (class before, class, cost),
    0 where nothing is said; a stretch begins and ends with the class ""."""

    def __init__(self, entries, links=()):
        self.words: dict[str, tuple] = entries if isinstance(entries, dict) else words_of(entries)
        #: By a word's first two characters: the length of the longest one.
        self.longest: dict[str, int] = {}
        for surface in self.words:
            if len(surface) > self.longest.get(surface[:2], 0):
                self.longest[surface[:2]] = len(surface)
        self.links = {(a, b): int(c) for a, b, c in links}
        self.known: dict[str, tuple] = {}
        self.held = 0

    def edges(self, text: str, at: int, run: list[int]):
        """(end, pos_major, pos_sub, cost, known) of the words that begin at a place; run: where the run of one kind ends."""
        most = max(self.longest.get(text[at : at + 2], 0), self.longest.get(text[at], 0))
        for i in range(at + 1, min(at + most, len(text)) + 1):
            for major, sub, cost in self.words.get(text[at:i], ()):
                yield i, major, sub, cost, True
        major, sub = OF_KIND.get(kind(text[at]), ("noun", "general"))
        for end in {at + 1, run[at]}:
            yield end, major, sub, UNKNOWN + UNKNOWN_CHARACTER * (end - at), False

    def path(self, text: str) -> tuple[int, list[tuple]]:
        """Cost and words (surface, pos_major, pos_sub, known) of a stretch without white space."""
        if text in self.known:
            return self.known[text]
        n = len(text)
        run = [n] * n
        for i in range(n - 2, -1, -1):
            run[i] = run[i + 1] if kind(text[i]) == kind(text[i + 1]) else i + 1
        # At each place, by class of the word that ends there: cost, words so far, where it begins, class before, the word.
        best: list[dict] = [{} for _ in range(n + 1)]
        best[0][""] = (0, 0, -1, "", None)
        for at in range(n):
            if not best[at]:
                continue
            for end, major, sub, cost, known in self.edges(text, at, run):
                here = min(((c + self.links.get((before, major), 0) + cost, w + 1, at, before) for before, (c, w, *_) in best[at].items()))
                old = best[end].get(major)
                if old is None or here < old[:4]:
                    best[end][major] = (*here, (text[at:end], major, sub, known))
        total, _, major = min((c + self.links.get((m, ""), 0), (w, b, m), m) for m, (c, w, b, *_) in best[n].items()) if n else (0, 0, "")
        words, at = [], n
        while at > 0:
            _, _, start, before, word = best[at][major]
            words.append(word)
            at, major = start, before
        found = (total, words[::-1])
        if n <= STRETCH:
            if self.held + n > REMEMBERED:
                self.known.clear()
                self.held = 0
            self.known[text] = found
            self.held += n
        return found

    def tokens(self, text: str):
        """(surface, pos_major, pos_sub, known, start, end) of a whole text, white space included."""
        at = 0
        for piece in _SPACE.split(text):
            if piece and piece.isspace():
                yield piece, "space", "general", True, at, at + len(piece)
                at += len(piece)
                continue
            for surface, major, sub, known in self.path(piece)[1]:
                yield surface, major, sub, known, at, at + len(surface)
                at += len(surface)


class Paths:
    """Words of several stretches: those of the i-th are first[i] to first[i + 1], each with its length, the place of its class in
    `classes`, and whether it is known."""

    def __init__(self, classes: list, counts: np.ndarray, size: np.ndarray, major: np.ndarray, known: np.ndarray):
        self.classes, self.size, self.major, self.known = classes, size, major, known
        self.first = np.concatenate(([0], np.cumsum(counts)))

    def per_stretch(self, which: np.ndarray) -> np.ndarray:
        """How many of a stretch's words are marked."""
        sums = np.concatenate(([0], np.cumsum(which)))
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def are(self, classes) -> np.ndarray:
        return np.isin(self.major, [i for i, c in enumerate(self.classes) if c in classes])


#: By code point: the number of its kind in KINDS; 255 where nobody has asked yet.
_KIND = np.full(0x110000, 255, np.uint8)
KINDS = ("digit", "latin", "kanji", "kana", "katakana", "letter", "symbol")


def _kinds(points: np.ndarray) -> np.ndarray:
    for c in np.unique(points[_KIND[points] == 255]).tolist():
        _KIND[c] = KINDS.index(kind(chr(c)))
    return _KIND[points]


class Together:
    """The paths of an Analyser, of many short stretches at once: all of them go on by a character at a time.

    Runs of characters that may be words are told by hashes; what a path takes for a known word is looked at, and a stretch in which one
    is not is analysed alone, as are long ones and all where links have a say."""

    def __init__(self, analyser: Analyser):
        self.alone = analyser
        words = analyser.words
        majors = {m for of in words.values() for m, _, _ in of}
        self.classes = sorted({"", "noun", *(m for m, _ in OF_KIND.values()), *(m for m in majors if m is not None)})
        number = {m: i for i, m in enumerate(self.classes)}
        self.names = [w for w in words if len(w) <= STRETCH]
        most = max((abs(c) for of in words.values() for *_, c in of), default=0)
        self.able = not analyser.links and None not in majors and len(self.classes) <= 256 and most < 1 << 32
        if not self.able:
            return
        rows = [(i, number[m], c) for i, w in enumerate(self.names) for m, c in self._cheapest(words[w])]
        of, self.major, self.cost = (np.array(x, np.int64) for x in (zip(*rows) if rows else ((), (), ())))
        self.unknown = np.array([number[OF_KIND.get(k, ("noun", ""))[0]] for k in KINDS])
        sizes = self.sizes = np.array([len(w) for w in self.names], np.int64)
        hashes = _Windows("".join(self.names)).hashes(np.cumsum(sizes) - sizes, sizes) if self.names else np.zeros(0, np.uint64)
        self.lengths, by = np.unique(sizes), np.argsort(hashes)
        self.hashes, self.word = hashes[by], by
        self.able = bool((self.hashes[1:] != self.hashes[:-1]).all())
        self.begin, self.entries = np.searchsorted(of, np.arange(len(self.names))), np.bincount(of, minlength=len(self.names))
        # Most runs are no word; a table of bits says so of nearly all of them.
        self.mask = np.uint64((1 << max(10, (16 * len(hashes)).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[(hashes & self.mask).astype(np.int64)] = True

    @staticmethod
    def _cheapest(entries: tuple) -> list[tuple]:
        best: dict = {}
        for major, _, cost in entries:
            best[major] = min(cost, best.get(major, cost))
        return list(best.items())

    def paths(self, stretches: list[str]) -> Paths:
        """Of different stretches without white space."""
        alone = [i for i, s in enumerate(stretches) if not self.able or not 0 < len(s) <= STRETCH]
        short = np.setdiff1d(np.arange(len(stretches)), alone)
        short = short[np.argsort([-len(stretches[i]) for i in short], kind="stable")]
        found = []  # (stretch, number of its word, length, class, known)
        while len(short):
            n = max(1, STATES // ((len(stretches[short[0]]) + 1) * len(self.classes)))
            some, short = short[:n], short[n:]
            words, wrong = self._together([stretches[i] for i in some])
            found.append((some[words[0]], *words[1:]))
            alone += some[wrong].tolist()
        classes = {m: i for i, m in enumerate(self.classes)}
        for i in alone:
            words = self.alone.path(stretches[i])[1]
            major = np.array([classes.setdefault(m, len(classes)) for _, m, _, _ in words], np.int64)
            found.append((np.full(len(words), i), np.arange(len(words)), np.array([len(w) for w, *_ in words], np.int64), major, np.array([k for *_, k in words], bool)))
        of, at, size, major, known = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(5))
        by = np.lexsort((at, of))
        return Paths(list(classes), np.bincount(of, minlength=len(stretches)), size[by], major[by], known[by].astype(bool))

    def _together(self, stretches: list[str]):
        """Words (stretch, number, length, class, known) of stretches, the longest first; and those that have to be analysed alone."""
        sizes = np.array([len(s) for s in stretches], np.int64)
        starts, text = np.cumsum(sizes) - sizes, "".join(stretches)
        windows, n, k = _Windows(text), len(text), len(self.classes)
        of = np.repeat(np.arange(len(sizes)), sizes)
        place, room = np.arange(n) - starts[of], (starts + sizes)[of] - np.arange(n)
        # Known words at all places, then by place.
        at, word = [], []
        for size in self.lengths.tolist():
            here = np.flatnonzero(room >= size)
            if not len(here):
                break
            hashed = windows.hashes(here, size)
            maybe = self.bits[(hashed & self.mask).astype(np.int64)]
            here, hashed = here[maybe], hashed[maybe]
            where = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
            hit = self.hashes[where] == hashed
            at.append(here[hit])
            word.append(self.word[where[hit]])
        at, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, word))
        times = self.entries[word]
        at, word, entry = np.repeat(at, times), np.repeat(word, times), np.repeat(self.begin[word], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        by = np.argsort(place[at].astype(np.uint8), kind="stable")
        at, word, entry = at[by], word[by], entry[by]
        cuts = np.searchsorted(place[at], np.arange(int(sizes.max()) + 1))
        # Runs of one kind.
        kinds = _kinds(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
        begins = np.flatnonzero((place == 0) | np.concatenate(([True], kinds[1:] != kinds[:-1])))
        run = np.append(begins[1:], n)[np.searchsorted(begins, np.arange(n), "right") - 1] - np.arange(n)
        # Cost, words so far, where the last one begins and the class before it, in one number each; the last word's own, -1 if unknown.
        best = np.full((len(sizes), int(sizes.max()) + 1, k), np.iinfo(np.int64).max)
        known = np.full(best.shape, -1, np.int32)
        best[:, 0, 0] = 0
        ranks = np.arange(k)

        def take(s, end, major, key, what):
            less = key < best[s, end, major]
            s, end, major = s[less], end[less], major[less]
            best[s, end, major], known[s, end, major] = key[less], what[less] if isinstance(what, np.ndarray) else what

        for p in range(int(sizes.max())):
            on = int(np.searchsorted(-sizes, -p))  # stretches that are longer
            pred = ((best[:on, p, :] >> 14 << 8) | ranks).min(axis=1)
            pred, before = pred >> 8, pred & 255
            base = ((pred >> 7) << 21) + (((pred & 127) + 1) << 14) + (p << 8) + before
            e = slice(cuts[p], cuts[p + 1])
            s = of[at[e]]
            take(s, p + self.sizes[word[e]], self.major[entry[e]], base[s] + (self.cost[entry[e]] << 21), word[e])
            flat, s = starts[:on] + p, np.arange(on)
            major = self.unknown[kinds[flat]]
            take(s, np.full(on, p + 1), major, base + (UNKNOWN + UNKNOWN_CHARACTER << 21), -1)
            s = s[run[flat] > 1]
            size = run[flat[s]]
            take(s, p + size, major[s], base[s] + (UNKNOWN + UNKNOWN_CHARACTER * size << 21), -1)
        rows = np.arange(len(sizes))
        major = ((best[rows, sizes, :] >> 8 << 8) | ranks).argmin(axis=1)
        out, end, wrong, number = [], sizes.copy(), np.zeros(len(sizes), bool), 0
        while len(rows):
            key, what = best[rows, end, major], known[rows, end, major]
            start, before = key >> 8 & 63, key & 255
            out.append((rows, np.full(len(rows), number), end - start, major, what >= 0))
            sure = np.flatnonzero(what >= 0)
            for i, a, b, w in zip(rows[sure].tolist(), (starts[rows[sure]] + start[sure]).tolist(), (starts[rows[sure]] + end[sure]).tolist(), what[sure].tolist()):
                if text[a:b] != self.names[w]:
                    wrong[i] = True
            more = start > 0
            rows, end, major, number = rows[more], start[more], before[more], number - 1
        words = [np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(5)]
        good = ~wrong[words[0]]
        return [w[good] for w in words], np.flatnonzero(wrong)


def sentence_spans(text: str):
    """(start, end) of the pieces between 。！？ and line breaks, without white space at their ends; blank ones go."""
    at = 0
    for piece in re.split(SENTENCE_END, text):
        start = text.index(piece, at)
        at = start + len(piece)
        bare = piece.strip()
        if bare:
            first = start + piece.index(bare)
            yield first, first + len(bare)


def shared(lexicon: DataFrame, links: DataFrame | None = None):
    """The lexicon by surface, for all tasks, once its size has been looked at."""
    n = lexicon.count()
    if n > MOST_ENTRIES:
        raise ValueError(f"a lexicon of {n} entries, more than {MOST_ENTRIES}")
    columns = lexicon.select("surface", "pos_major", "pos_sub", "cost").toArrow().to_batches()
    words = words_of(r for b in columns for r in zip(*(c.to_pylist() for c in b.columns)))
    return lexicon.sparkSession.sparkContext.broadcast((words, [tuple(r) for r in links.select("before", "after", "cost").collect()] if links is not None else []))


def _slices(batch: pa.RecordBatch, texts: int = 1, most: int = CHARACTERS):
    """Parts of a batch whose texts, a column of it, have `most` characters together or are a single one; null counts as empty."""
    first, n = 0, 0
    for i, size in enumerate(pc.utf8_length(batch.column(texts)).to_pylist()):
        if i > first and n + (size or 0) > most:
            yield batch.slice(first, i - first)
            first, n = i, 0
        n += size or 0
    if first < batch.num_rows:
        yield batch.slice(first)


def _each(docs: DataFrame, entries, work, schema: str, doc_id: str, text: str) -> DataFrame:
    """Rows that `work(analyser, text)` gives for each document, after its doc_id."""
    kind_of = docs.schema[doc_id].dataType.simpleString()
    target = pa.schema([pa.field(n, {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in (c.split(" ") for c in schema.split(", "))])

    def run(batches):
        analyser = Analyser(*entries.value)
        for batch in batches:
            rows = ((d.as_py(), *r) for d, t in zip(*batch.columns) for r in work(analyser, t.as_py() or ""))
            # Tokens are many times what their texts are, so they go on as they come.
            while some := list(islice(rows, ROWS)):
                columns = list(zip(*some))
                arrays = [pa.array(columns[0], batch.column(0).type), *(pa.array(c, f.type) for c, f in zip(columns[1:], target))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *target.names])

    return spread(docs).select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind_of}, {schema}")


def _sentence_tokens(analyser: Analyser, text: str):
    for s, (a, b) in enumerate(sentence_spans(text)):
        for p, (surface, major, sub, known, start, end) in enumerate(analyser.tokens(text[a:b])):
            yield s, p, surface, major, sub, known, a + start, a + end


def analysed(docs: DataFrame, lexicon: DataFrame, links: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sent_id and pos (from 0), surface, pos_major, pos_sub, known, start and end (code points of the whole text) of each
    token of each sentence; tokens of a sentence follow each other without a gap."""
    return _each(docs, shared(lexicon, links), _sentence_tokens, TOKEN, doc_id, text)


def content_words(tokens: DataFrame, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and words: tokens of meaning in their order, without stop words."""
    kept = tokens.filter(F.col("pos_major").isin(*CONTENT))
    kept = kept.filter(~F.col("surface").isin(*stop_words)) if stop_words else kept
    return kept.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "pos", "surface"))), lambda x: x["surface"]).alias("words"))


def _numbered(pieces: list[str]) -> tuple[list[str], np.ndarray]:
    """The different ones, and the number of each."""
    number = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
    return list(number), np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))


def _sums(x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, x, n).astype(np.int64)


def token_counts(docs: DataFrame, lexicon: DataFrame, links: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and how many tokens analysed() gives it, how many of them unknown, and how many of meaning (null for none); counted
    where the document stands, so no token becomes a row."""
    entries, kind_of = shared(lexicon, links), docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        together = Together(Analyser(*entries.value))
        for batch in (part for whole in batches for part in _slices(whole, most=TOGETHER)):
            said = [[t[a:b].split() for a, b in sentence_spans(t)] if t else [] for t in batch.column(1).to_pylist()]
            stretches, code = _numbered([p for of in said for s in of for p in s])
            paths, n = together.paths(stretches), len(said)
            doc = np.repeat(np.arange(n), [sum(map(len, of)) for of in said])
            # A token more between each two stretches of a sentence.
            tokens = _sums(np.diff(paths.first)[code] + 1, doc, n) - np.array([len(of) for of in said])
            unknown, content = (_sums(paths.per_stretch(which)[code], doc, n) for which in (~paths.known, paths.are(CONTENT)))
            some = np.flatnonzero([bool(of) for of in said])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), *(pa.array(x[some]) for x in (tokens, unknown, content))], ["doc_id", "tokens", "unknown", "content"])

    each = spread(docs).select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind_of}, tokens bigint, unknown bigint, content bigint")
    sums = each.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("tokens", "unknown", "content")))
    return sums.withColumn("content", F.when(F.col("doc_id").isNotNull() & (F.col("content") > 0), F.col("content")))


def _one_each(docs: DataFrame, doc_id: str) -> bool:
    """Whether no document comes in several rows."""
    return docs.groupBy(docs[doc_id].alias("doc_id")).count().filter("count > 1").isEmpty()


def _term_sums(sums: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["term", "n"])


def _nouns(docs: DataFrame, lexicon: DataFrame, links: DataFrame | None, doc_id: str, text: str, take, schema: str) -> DataFrame:
    """Rows (record batches) that `take` makes of the spans of each slice of documents: of (doc_id, text, spans in order) of each."""
    entries, kind_of = shared(lexicon, links), docs.schema[doc_id].dataType.simpleString()
    numbers = ("piece", "blank", "pieces", "words", "word")

    def analyse(batches):
        together = Together(Analyser(*entries.value))
        for batch in (part for whole in batches for part in _slices(whole, most=TOGETHER)):
            split = [_SPACE.split(t or "") for t in batch.column(1).to_pylist()]
            stretches, piece = _numbered([p for s in split for p in s[::2]])
            blank = np.fromiter((len(p) for s in split for p in chain(s[1::2], ("",))), np.int64, len(piece))
            paths = together.paths(stretches)
            # A word is the number of its surface, if it is a noun that has to be judged, else its length below 0.
            word, noun = -paths.size, np.flatnonzero(paths.are(("noun",)) & (paths.size >= 2))
            begin = np.cumsum(paths.size) - paths.size
            whole = "".join(stretches)
            surfaces, word[noun] = _numbered([whole[a:b] for a, b in zip(begin[noun].tolist(), (begin + paths.size)[noun].tolist())])
            row = [batch.column(0), batch.column(1), pa.array(surfaces, pa.string())]
            row = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in row]
            columns = (piece, blank, np.array([len(s[::2]) for s in split]), np.diff(paths.first), word)
            yield pa.RecordBatch.from_arrays([*row, *(pa.array([c.astype(np.int32).tobytes()], pa.binary()) for c in columns)], ["ids", "texts", "surfaces", *numbers])

    def find(batches):
        for batch in (whole.slice(i, 1) for whole in batches for i in range(whole.num_rows)):
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            ids, texts = at["ids"].flatten(), at["texts"].to_pylist()[0]
            surfaces, valid = at["surfaces"].to_pylist()[0], at["valid"].to_pylist()[0]
            piece, blank, pieces, words, word = (np.frombuffer(at[n][0].as_py(), np.int32).tolist() for n in numbers)
            steps, i = [], 0  # of each stretch: (how far to go, the noun there), and how far from the last one to its end
            for n in words:
                of, far = [], 0
                for w in word[i : i + n]:
                    if w < 0:
                        far -= w
                    elif valid[w]:
                        of.append((far, surfaces[w], len(surfaces[w])))
                        far = 0
                steps.append((of, far))
                i += n

            def spans():
                i = 0
                for d, (t, n) in enumerate(zip(texts, pieces)):
                    found, offset = set(), 0
                    for p, space in zip(piece[i : i + n], blank[i : i + n]):
                        of, rest = steps[p]
                        for far, surface, size in of:
                            offset += far
                            start = t.find(surface, offset)
                            if start >= 0:
                                found.add((surface, start))
                                offset = start
                            offset += size
                        offset += rest + space
                    i += n
                    yield d, found

            yield from take(ids, spans())

    picked = spread(docs).select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    each = picked.mapInArrow(analyse, f"ids array<{kind_of}>, texts array<string>, surfaces array<string>, " + ", ".join(f"{n} binary" for n in numbers))
    # Judged between the two steps, by the expression that all other terms are judged by, each surface once.
    return each.withColumn("valid", F.transform("surfaces", T.is_valid_term)).mapInArrow(find, schema)


def noun_spans(docs: DataFrame, lexicon: DataFrame, links: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, term, start, end of nouns of two characters and more that are valid (F6), found from an offset that moves as
    tokens go: behind a valid noun's place, by the length of any other token, but not over a noun that is refused; so a noun after
    such a one may be found at an earlier place than its own. A place comes once for each term."""

    def rows(ids, spans):
        each = ((d, *f) for d, found in spans for f in sorted(found))
        while some := list(islice(each, ROWS)):
            d, term, start = zip(*some)
            end = [a + len(t) for t, a in zip(term, start)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array(term, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "term", "start", "end"])

    return _nouns(docs, lexicon, links, doc_id, text, rows, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, term string, start bigint, end bigint")


def noun_frequency(docs: DataFrame, lexicon: DataFrame, links: DataFrame | None = None, minimum: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """F5 of X9: candidate_frequency(noun_spans(...)). Where no document comes in several rows, its places are counted where it stands,
    and sums alone leave the task."""
    if not _one_each(docs, doc_id):
        return candidate_frequency(noun_spans(docs, lexicon, links, doc_id, text), minimum)

    def sums(_, spans):
        out: Counter = Counter()
        for _, found in spans:
            out.update({t: n for t, n in Counter(t for t, _ in found).items() if n >= minimum})
        yield _term_sums(out)

    return _nouns(docs, lexicon, links, doc_id, text, sums, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("frequency"))


def ngram_frequency(docs: DataFrame, lexicon: DataFrame, links: DataFrame | None = None, low: int = 2, high: int = 6, minimum: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """F5 of X10: candidate_frequency(ngram_spans(analysed(...))). White space ends a run, so a stretch's runs are found once for all
    its places in a slice of documents; where no document comes in several rows, sums alone leave the task, and are judged then."""
    if not _one_each(docs, doc_id):
        return candidate_frequency(ngram_spans(analysed(docs, lexicon, links, doc_id, text), low, high), minimum)
    entries = shared(lexicon, links)

    def run(batches):
        together = Together(Analyser(*entries.value))
        for batch in (part for whole in batches for part in _slices(whole, most=TOGETHER)):
            said = [[p for a, b in sentence_spans(t) for p in t[a:b].split()] if t else [] for t in batch.column(1).to_pylist()]
            stretches, code = _numbered([p for of in said for p in of])
            paths = together.paths(stretches)
            counts, mark, i = np.diff(paths.first), paths.are(COMPOUND), 0
            of = np.repeat(np.arange(len(stretches)), counts)
            both = np.flatnonzero(mark[1:] & mark[:-1] & (of[1:] == of[:-1]))
            grams: list[list[str]] = [[] for _ in stretches]
            for s in np.unique(of[both]).tolist():
                a, b = paths.first[s], paths.first[s + 1]
                cuts = np.concatenate(([0], np.cumsum(paths.size[a:b]))).tolist()
                joins, first = mark[a:b].tolist(), 0
                for stop in range(len(joins) + 1):
                    if stop == len(joins) or not joins[stop]:
                        grams[s] += [stretches[s][cuts[x] : cuts[x + n]] for n in range(low, min(high, stop - first) + 1) for x in range(first, stop - n + 1)]
                        first = stop + 1
            out: Counter = Counter()
            code = code.tolist()
            for n in map(len, said):
                here = Counter(g for c in code[i : i + n] for g in grams[c])
                out.update({t: k for t, k in here.items() if k >= minimum})
                i += n
            yield _term_sums(out)

    picked = spread(docs).select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return picked.mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("frequency")).filter(T.is_valid_term(F.col("term")))


def ngram_spans(tokens: DataFrame, low: int = 2, high: int = 6) -> DataFrame:
    """doc_id, term, start, end of all runs of low..high tokens within runs of nouns and prefixes of a sentence, valid ones
    alone. tokens: as analysed() gives them."""
    runs = _islands(tokens, F.col("pos_major").isin(*COMPOUND))
    parts = F.array_sort(F.collect_list(F.struct("pos", "surface", "start", "end")))
    runs = runs.groupBy("doc_id", "sent_id", "island").agg(parts.alias("parts"))
    term = lambda i, n: F.array_join(F.transform(F.slice("parts", i + 1, F.lit(n)), lambda x: x["surface"]), "")
    gram = lambda i, n: F.struct(term(i, n).alias("term"), F.get("parts", i)["start"].alias("start"), F.get("parts", i + (n - 1))["end"].alias("end"))
    of = lambda n: F.when(F.size("parts") >= n, F.transform(F.sequence(F.lit(0), F.size("parts") - n), lambda i: gram(i, n)))
    grams = F.filter(F.flatten(F.array_compact(F.array(*(of(n) for n in range(low, high + 1))))), lambda g: T.is_valid_term(g["term"]))
    return runs.select("doc_id", F.explode(grams).alias("g")).select("doc_id", "g.*").distinct()


def lexicon_of(words: DataFrame, least: int = 5, most: int = 200_000) -> DataFrame:
    """A lexicon from counted words (surface, n) that come at least so often, the most frequent `most` of them: the cost is 100 times the
    negative logarithm of their share, the class "particle" for words of up to three letters, "noun" for others, with "number" for digits."""
    kept = words.filter((F.col("n") >= least) & (F.length("surface") > 0)).orderBy(F.desc("n"), "surface").limit(most)
    total = kept.agg(F.sum("n").alias("total"))
    number = F.col("surface").rlike("^[0-9]+$")
    major = F.when(number | (F.length("surface") > 3), "noun").otherwise("particle")
    costed = kept.join(F.broadcast(total)).withColumn("cost", F.round(-100 * F.log(F.col("n") / F.col("total"))).cast("int"))
    return costed.select("surface", major.alias("pos_major"), F.when(number, "number").otherwise("general").alias("pos_sub"), "cost")


#: Words at the beginning of a longer term that make it a caption, and marks that a term may hold.
CAPTIONS, TERM_MARKS = ("図", "表", "式"), ("％", "°", "/", "-", "・")
#: Abbreviations that no class is asked of.
ABBREVIATION = "^[A-Z]{2,5}[0-9x]?$"


def valid_by_classes(words: Column) -> Column:
    """The part of F6 that goes by word classes, of a term's tokens (surface, pos_major, pos_sub): none begins with a caption or a
    counter, none is a particle, an auxiliary or a dependent noun, and all are nouns, prefixes, suffixes or marks of terms."""
    first = F.get(words, F.lit(0))
    allowed = lambda w: w["pos_major"].isin("noun", "prefix", "suffix") | ((w["pos_major"] == "symbol") & w["surface"].isin(*TERM_MARKS))
    dependent = lambda w: (w["pos_major"] == "noun") & (w["pos_sub"] == "dependent")
    caption = first["surface"].isin(*CAPTIONS) & (F.size(words) > 1)
    return F.when(F.size(words) == 0, True).otherwise(~caption & (first["pos_sub"] != "counter") & F.forall(words, lambda w: allowed(w) & ~dependent(w)))


def valid_terms(terms: DataFrame, lexicon: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """F6 with its word classes: the rows of `terms` (term) that is_valid_term keeps and whose tokens fit; codes and abbreviations are
    taken as they are. Terms with white space have a token that is none of these and go."""
    entries = shared(lexicon, links)
    kept = terms.filter(T.is_valid_term(F.col("term")))
    plain = T.is_code(F.col("term")) | F.col("term").rlike(ABBREVIATION)
    asked = kept.filter(~plain).select("term").distinct()

    def run(batches):
        analyser = Analyser(*entries.value)
        for batch in batches:
            words = [[{"surface": w, "pos_major": major, "pos_sub": sub} for w, major, sub, *_ in analyser.tokens(t)] for t in batch.column(0).to_pylist()]
            kind = pa.list_(pa.struct([("surface", pa.string()), ("pos_major", pa.string()), ("pos_sub", pa.string())]))
            yield batch.append_column("words", pa.array(words, kind))

    tokens = asked.mapInArrow(run, "term string, words array<struct<surface:string,pos_major:string,pos_sub:string>>")
    good = tokens.filter(valid_by_classes(F.col("words"))).select("term")
    return kept.filter(plain).unionByName(kept.filter(~plain).join(good, "term", "left_semi").select(kept.columns))
