"""Term mining: candidates, TF-IDF, C-value, nested terms and their combination."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import spread, written

#: Bits of a filter of terms at most, 8 MB in every task: its size decides how much of what isn't a term leaves a task, not what is found.
FILTER_BITS = 1 << 26
#: Numbers of first characters by which places in a text are chosen before whole terms are looked for, and characters of a text looked
#: at together.
LEADS, STRETCH = (8, 16, 32), 1 << 20
#: Sums of different terms that a task holds before it hands them on; tokens that it looks at together.
HELD, SLICE = 200_000, 500_000


def ngrams(tokens: str, low: int, high: int) -> Column:
    """(term, start, size) of all runs of low..high tokens of an array column."""

    def of(n: int) -> Column:
        run = lambda i: F.struct(F.array_join(F.slice(tokens, i + 1, F.lit(n)), " ").alias("term"), i.alias("start"), F.lit(n).alias("size"))
        return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.size(tokens) - n), run))

    runs = [of(n) for n in range(low, high + 1)]
    empty = F.array().cast("array<struct<term:string,start:int,size:int>>")
    return F.flatten(F.array(*(F.coalesce(r, empty) for r in runs)))


def _tokens_of(column: pa.Array):
    """Of an array of documents, each an array of its sentences' tokens, some documents at a time, about SLICE tokens: the different
    tokens, and for each place its token, its sentence, its document, and how many tokens from there on can make a run."""
    sentences = column.flatten()
    length = lambda a: np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
    first, start, tokens = length(column), length(sentences), sentences.flatten()
    doc_start = start[first]
    cuts = np.unique(np.searchsorted(doc_start, np.arange(0, doc_start[-1], SLICE)))
    for a, b in zip(cuts, np.append(cuts[1:], len(column))):
        words = pc.dictionary_encode(tokens[doc_start[a] : doc_start[b]])
        token = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        each = np.diff(start[first[a] : first[b] + 1])
        sentence = np.repeat(np.arange(len(each)), each)
        doc = np.repeat(np.arange(b - a), np.diff(doc_start[a : b + 1]))
        gaps = np.append(np.flatnonzero(token < 0), len(token))
        end = np.minimum(np.repeat(np.cumsum(each), each), gaps[np.searchsorted(gaps, np.arange(len(token)))])
        yield words.dictionary.to_pylist(), token, sentence, doc, end - np.arange(len(token))


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def _joined(names: list[str], token: np.ndarray, at: np.ndarray, n: int) -> list[str]:
    return [" ".join(names[t] for t in run) for run in token[at[:, None] + np.arange(n)].tolist()]


def mined(docs: DataFrame, sentences: Column, low: int = 2, high: int = 6, minimum: int = 2) -> DataFrame:
    """F5, W8 in one: term (tokens joined by a blank), size and frequency of all runs of low..high tokens of a sentence that a
    document has `minimum` times at least. sentences: for each document, the array of its sentences' tokens.

    A document is one row, so its runs are counted where it stands, and only those that repeat leave the task; a run that
    doesn't repeat has no longer one that does. Null sentences have no runs."""

    def count(batches):
        for batch in batches:
            for names, token, _, doc, left in _tokens_of(batch.column(0)):
                terms, sizes, counts = [], [], []
                at = np.flatnonzero(left >= low)
                code = token[at]
                for j in range(1, low):
                    code = _dense(code * len(names) + token[at + j])
                for n in range(low, high + 1):
                    if n > low:
                        longer = left[at] >= n
                        at, code = at[longer], code[longer]
                        code = _dense(code * len(names) + token[at + n - 1])
                    _, of, here = np.unique(doc[at] * (code.max(initial=0) + 1) + code, return_inverse=True, return_counts=True)
                    often = here[of] >= minimum
                    at, code = at[often], code[often]
                    if not len(at):
                        break
                    _, first, total = np.unique(code, return_index=True, return_counts=True)
                    terms += _joined(names, token, at[first], n)
                    sizes.append(np.full(len(first), n))
                    counts.append(total)
                if terms:
                    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(np.concatenate(sizes), pa.int32()), pa.array(np.concatenate(counts), pa.int64())], ["term", "size", "n"])

    each = spread(docs).select(sentences.alias("sentences")).mapInArrow(count, "term string, size int, n bigint")
    return each.groupBy("term", "size").agg(F.sum("n").alias("frequency")).select("term", "frequency", "size")


def candidate_frequency(spans: DataFrame, minimum: int = 2, key: str = "doc_id") -> DataFrame:
    """term, frequency. Terms with fewer than minimum distinct spans in a document don't count there."""
    each = spans.groupBy(key, "term").agg(F.countDistinct("start", "end").alias("n")).filter(F.col("n") >= minimum)
    return each.groupBy("term").agg(F.sum("n").alias("frequency"))


def _filter(hashes: DataFrame, bits: int, n: int | None = None) -> np.ndarray:
    """A filter of hashes (column hash): bits, a power of two and about 16 for each hash, that are set. n: how many there are at most,
    where it is known. Only the words that have a bit come to the driver, bits / 64 at most and 16 bytes each."""
    n = hashes.count() if n is None else n
    size = min(bits, 1 << max(6, (16 * n).bit_length()))
    words = hashes.select(F.pmod("hash", F.lit(size)).alias("bit")).groupBy(F.expr("shiftright(bit, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("v")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("v").to_numpy()
    return out.view(np.uint64)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter knows, or takes for known."""
    at = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def tfidf(docs: DataFrame, sentences: Column, candidates: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """A5: term, df, tfidf. docs has a row for each document, sentences the array of its sentences' tokens; candidates has term
    (tokens joined by a blank) and size. tf is 1 + ln f in each sentence, summed; df counts documents, idf is
    ln((N + 1) / (df + 1)) + 1, N the number of documents with a sentence.

    Documents are read once, however many candidates there are: the hashes of all runs of tokens are made from those of tokens, runs that a
    filter of all candidates knows are counted and leave the task as sums, and what is none goes where they meet the candidates."""
    wanted = written(candidates.select("term", "size").distinct(), "terms")
    known = docs.sparkSession.sparkContext.broadcast(_filter(_term_hashes(wanted, None), bits))
    sizes = sorted(r[0] for r in wanted.select("size").distinct().collect())  # a number for each length in tokens
    docs = spread(docs).select(sentences.alias("sentences"))

    def count(batches):
        for batch in batches:
            documents = int(np.count_nonzero(pc.fill_null(pc.list_value_length(batch.column(0)), 0)))
            out = [([None], [documents], [0.0])]  # the row without a term counts documents
            for names, token, sentence, doc, left in _tokens_of(batch.column(0)):
                hashes = _run_hashes(names, token, left)
                for n in range(1, max(sizes, default=0) + 1):
                    at, hashed = next(hashes)
                    if n not in sizes:
                        continue
                    at = at[_passes(known.value, hashed)]
                    if not len(at):
                        continue
                    code = token[at]
                    for j in range(1, n):
                        code = _dense(code * len(names) + token[at + j])
                    some, first, code = np.unique(code, return_index=True, return_inverse=True)
                    runs, f = np.unique(code * (sentence[-1] + 1) + sentence[at], return_counts=True)
                    tf = np.bincount(runs // (sentence[-1] + 1), 1 + np.log(f), len(some))
                    df = np.bincount(np.unique(code * (doc[-1] + 1) + doc[at]) // (doc[-1] + 1), minlength=len(some))
                    out.append((_joined(names, token, at[first], n), df, tf))
            columns = [[x for o in out for x in o[0]], *(np.concatenate([o[i] for o in out]) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.float64()))], ["term", "df", "tf"])

    found = docs.mapInArrow(count, "term string, df bigint, tf double")
    per_term = written(found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")), "tf")
    n = (per_term.filter("term is null").agg(F.sum("df")).first()[0]) or 0
    idf = F.log((F.lit(n) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1
    scored = wanted.join(per_term, "term", "left")
    return scored.select("term", F.coalesce("df", F.lit(0)).alias("df"), F.round(F.coalesce("tf", F.lit(0.0)) * idf, 6).alias("tfidf"))


_R = 0x9E3779B97F4A7C15


def _powers(base: int, n: int = STRETCH) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASES = _R, pow(_R, -1, 2**64)
_POWERS = _powers(_BASES[0]), _powers(_BASES[1])


class _Windows:
    """Hashes of runs of characters of a stretch of text, of any length and at any places."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n, self.sums = len(points), np.zeros(len(points) + 1, np.uint64)
        self.powers = _POWERS if self.n <= STRETCH else tuple(_powers(b, self.n) for b in _BASES)
        np.cumsum(points * self.powers[0][: self.n], out=self.sums[1:])

    def hashes(self, places: np.ndarray, size) -> np.ndarray:
        """size: one for all places, or one for each."""
        return _mixed(self.of(places, size) + np.asarray(size).astype(np.uint64))

    def of(self, places: np.ndarray, size) -> np.ndarray:
        return (self.sums[places + size] - self.sums[places]) * self.powers[1][places]


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _run_hashes(names: list[str], token: np.ndarray, left: np.ndarray):
    """For runs of 1, 2, ... tokens, joined by a blank: where they begin, and the hashes that _term_hashes() gives their terms."""
    sizes = np.array([len(t or "") for t in names], np.int64)
    of, power, at = np.zeros(len(names), np.uint64), np.ones(len(names), np.uint64), 0
    for some in _stretches([t or "" for t in names]):
        here = sizes[at : at + len(some)]
        of[at : at + len(some)] = _Windows("".join(some)).of(np.cumsum(here) - here, here)
        at += len(some)
    for bit in range(int(sizes.max(initial=0)).bit_length()):
        power[sizes >> bit & 1 > 0] *= np.uint64(pow(_R, 1 << bit, 2**64))
    at = np.flatnonzero(left >= 1)
    blank = np.uint64(ord(" ") + 1)
    x, shift, size, n = of[token[at]], power[token[at]], sizes[token[at]], 1
    while True:
        yield at, _mixed(x + size.astype(np.uint64))
        n += 1
        kept = left[at] >= n
        at, x, shift, size = at[kept], x[kept], shift[kept], size[kept]
        t = token[at + n - 1]
        x = x + shift * (blank + np.uint64(_R) * of[t])
        shift, size = shift * np.uint64(_R) * power[t], size + 1 + sizes[t]


def _stretches(terms: list[str], most: int = STRETCH // 16):
    """Lists of terms of about `most` characters together, or of a single longer one."""
    some, n = [], 0
    for t in terms:
        if some and n + len(t) > most:
            yield some
            some, n = [], 0
        some.append(t)
        n += len(t)
    if some:
        yield some


def _term_hashes(terms: DataFrame, first: int | None, least: int = 0) -> DataFrame:
    """hash of each term of `least` characters and more, or of its first characters."""

    def run(batches):
        for batch in batches:
            for some in _stretches([t[:first] for t in batch.column(0).to_pylist()]):
                sizes = np.array([len(t) for t in some])
                found = _Windows("".join(some)).hashes(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["hash"])

    return terms.filter(F.length("term") >= least).select("term").mapInArrow(run, "hash bigint")


def _filters(terms: DataFrame, bits: int):
    """Lengths of terms (term, not empty), and filters of their first LEADS characters and of whole ones, for all tasks."""
    context, n = terms.sparkSession.sparkContext, terms.count()
    lengths = sorted(r[0] for r in terms.select(F.length("term")).distinct().collect())  # a number for each length
    kinds = [(lead, lead) for lead in LEADS if lengths and lead <= lengths[-1]] + [(None, 0)]
    return lengths, {first: context.broadcast(_filter(_term_hashes(terms, first, least), bits, n)) for first, least in kinds}


def _hits(w: _Windows, lengths: list[int], filters: dict, places: np.ndarray, room: np.ndarray):
    """(place, length), by length, of what may be terms at some places of a stretch; room: characters from each place on. A place at
    which no term's first characters stand is not looked at for longer ones; what is shorter than all leads is looked for as a whole."""
    leads = [lead for lead in LEADS if lead in filters]
    for size in lengths:
        while leads and leads[0] <= size:
            lead = leads.pop(0)
            places = places[room[places] >= lead]
            places = places[_passes(filters[lead].value, w.hashes(places, lead))]
        places = places[room[places] >= size]
        for i in places[_passes(filters[None].value, w.hashes(places, size))].tolist():
            yield i, size


def counted(texts: DataFrame, terms: DataFrame, text: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """X16 for many terms: term and total, its places in all texts, at any place of them and without overlap with itself.

    Texts are read once, however many terms there are. Places whose first characters a filter of all terms' beginnings
    knows are looked at with each length that terms have; runs of characters that a filter of whole terms knows are counted in the task,
    and what is none goes where the counts meet the terms. Terms that are nowhere have no row; one of more than STRETCH / 2
    characters is an error."""
    terms = written(terms.select("term").filter("term <> ''").distinct(), "terms")
    lengths, filters = _filters(terms, bits)
    if lengths and lengths[-1] > STRETCH // 2:
        raise ValueError(f"a term of {lengths[-1]} characters")

    def count(batches):
        total: Counter = Counter()
        step = STRETCH - (lengths[-1] if lengths else 0)
        for batch in batches:
            # Short texts are looked at together: a place has room to the end of its own one, so none of its terms goes on in the next.
            for some in _stretches([t for t in batch.column(0).to_pylist() if t] if lengths else []):
                t, sizes = "".join(some), np.array([len(x) for x in some])
                ends, free = np.repeat(np.cumsum(sizes), sizes), {}
                for start in range(0, len(t), step):
                    stretch = t[start : start + STRETCH]
                    w = _Windows(stretch)
                    # Places from `step` on belong to the next stretch.
                    room = np.minimum(ends[start : start + w.n] - start, w.n) - np.arange(w.n)
                    for i, size in _hits(w, lengths, filters, np.arange(min(step, w.n)), room):
                        term = stretch[i : i + size]
                        if free.get(term, 0) <= start + i:
                            free[term] = start + i + size
                            total[term] += 1
                if len(total) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])
                    total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    found = spread(texts.select(F.col(text).alias("t"))).mapInArrow(count, "term string, n bigint")
    return found.groupBy("term").agg(F.sum("n").alias("total")).join(terms, "term", "left_semi")


def containment(terms: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Short, long of each two terms of which one holds the other.

    Each term is looked through where it stands: runs of its characters that filters of all terms' beginnings and of whole terms know
    leave the task, a handful for each term, and what is none goes where they meet the terms. So what is shuffled is about the result,
    and nothing is broadcast but the filters. A term that comes several times has as many pairs."""
    rows = written(spread(terms.select("term").filter("term <> ''")), "terms")
    lengths, filters = _filters(rows, bits)

    def run(batches):
        for batch in batches:
            for some in _stretches(batch.column(0).to_pylist()):
                sizes = np.array([len(t) for t in some])
                ends, of = np.repeat(np.cumsum(sizes), sizes), np.repeat(np.arange(len(some)), sizes).tolist()
                text = "".join(some)
                hits = _hits(_Windows(text), lengths, filters, np.arange(len(text)), ends - np.arange(len(text)))
                # A term is longer than what it holds, and holds it once however many places it has there.
                found = {(of[i], text[i : i + size]) for i, size in hits if size < len(some[of[i]])}
                yield pa.RecordBatch.from_arrays([pa.array([t for _, t in found], pa.string()), pa.array([some[i] for i, _ in found], pa.string())], ["short", "long"])

    found = rows.mapInArrow(run, "short string, long string")
    return found.join(rows.withColumnRenamed("term", "short").hint("merge"), "short").select("short", "long")


def independent_ratio(texts: DataFrame, candidates: DataFrame, text: str = "text", pairs: DataFrame | None = None) -> DataFrame:
    """Term, total, ratio. The share of a term's occurrences that are in no longer candidate, 0 if it has none. pairs: the
    candidates' containment(), where it is at hand."""
    counts = written(counted(texts, candidates, text), "totals")
    pairs = containment(candidates.select("term")) if pairs is None else pairs
    inside = pairs.join(counts.withColumnRenamed("term", "long"), "long").groupBy("short").agg(F.sum("total").alias("inside"))
    out = candidates.select("term").join(counts, "term", "left").join(inside.withColumnRenamed("short", "term"), "term", "left")
    total = F.coalesce("total", F.lit(0))
    return out.select("term", total.alias("total"), F.round(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(total - F.coalesce("inside", F.lit(0)), total), F.lit(0.0))), 6).alias("ratio"))


def cvalue(candidates: DataFrame, ratios: DataFrame | None = None, least_ratio: float = 0.3, pairs: DataFrame | None = None) -> DataFrame:
    """Term, cvalue: log2(size + 1) * frequency less the mean frequency of longer terms that hold it, 0 at least. With
    ratios (term, ratio), also 0 for a term that others hold and of whose occurrences fewer are independent than
    least_ratio. candidates: term, size, frequency; pairs: their containment(), where it is at hand."""
    freq = candidates.select(F.col("term").alias("long"), F.col("frequency").alias("f"))
    pairs = containment(candidates.select("term")) if pairs is None else pairs
    longer = pairs.join(freq, "long").groupBy("short").agg(F.avg("f").alias("mean")).withColumnRenamed("short", "term")
    scored = candidates.join(longer, "term", "left")
    value = F.greatest(F.lit(0.0), F.log2(F.col("size") + 1.0) * F.col("frequency") - F.coalesce("mean", F.lit(0.0)))
    if ratios is not None:
        scored = scored.join(ratios.select("term", "ratio"), "term", "left")
        value = F.when(F.col("mean").isNotNull() & (F.coalesce("ratio", F.lit(0.0)) < least_ratio), 0.0).otherwise(value)
    return scored.select("term", F.round(value, 6).alias("cvalue"))


def min_max(df: DataFrame, column: str, name: str | None = None, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Scaled to 0..1; 0.5 where all values are the same. The bounds are an aggregate, not a window over all rows."""
    by = by or []
    bounds = df.groupBy(*by).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    joined = df.join(bounds, by) if by else df.crossJoin(F.broadcast(bounds))  # one row
    scaled = F.when(F.col("_high") - F.col("_low") < 1e-10, 0.5).otherwise((F.col(column) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)))
    return joined.withColumn(name or column, F.round(scaled, digits)).drop("_low", "_high")


def positive_min_max(df: DataFrame, column: str, name: str) -> DataFrame:
    """A10: scaled by the bounds of the positive values; 0 for the others."""
    bounds = df.filter(F.col(column) > 0).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    scaled = F.when(F.col(column) <= 0, 0.0).when(F.col("_high") - F.col("_low") < 1e-10, 0.5).otherwise((F.col(column) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)))
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, F.round(F.coalesce(scaled, F.lit(0.0)), 6)).drop("_low", "_high")


#: Weights of TF-IDF and C-value in the first and the final stage.
STAGE_WEIGHTS = {"seed": (0.3, 0.7), "final": (0.4, 0.6)}


def combined_score(scores: DataFrame, stage: str = "final") -> DataFrame:
    """Scores has term, size, tfidf, cvalue. Terms without C-value go; both scores are scaled and weighted, and
    compounds gain up to a half."""
    a, b = STAGE_WEIGHTS[stage]
    kept = min_max(min_max(scores.filter("cvalue > 0"), "tfidf", "t"), "cvalue", "c")
    bonus = F.when(F.col("size") >= 2, F.least(1 + 0.15 * (F.col("size") - 1), F.lit(1.5))).otherwise(1.0)
    return kept.select("term", F.round((a * F.col("t") + b * F.col("c")) * bonus, 6).alias("score"))


def best(scores: DataFrame, most: int = 1500) -> DataFrame:
    """T4: the terms with the highest scores; what compares terms with each other works on these."""
    return scores.orderBy(F.desc("score"), "term").limit(most)


def seeds(capped: DataFrame, percent: float = 15.0) -> DataFrame:
    """The best per cent of terms that best() has left, one at least."""
    return best(capped, max(1, int(capped.count() * percent / 100)))


def to_define(capped: DataFrame, percent: float = 50.0) -> DataFrame:
    """T5: all abbreviations and the best per cent of the other terms that best() has left."""
    short = F.coalesce(T.is_abbreviation(F.col("term")), F.lit(False))
    rest = capped.filter(~short)
    return capped.filter(short).unionByName(best(rest, int(rest.count() * percent / 100)))


def nested_filter(scores: DataFrame, ratio: float = 0.3, pairs: DataFrame | None = None) -> DataFrame:
    """without terms that a longer kept term holds and whose C-value is below ratio of its.

    A longer term counts only if it stays itself and has a C-value, so terms are settled from the longest down; rounds
    end when nothing is open. Each round settles every term whose longer ones are settled."""
    pairs = containment(scores.select("term")) if pairs is None else pairs
    value = scores.select("term", "cvalue")
    threats = pairs.join(value.withColumnRenamed("term", "short").withColumnRenamed("cvalue", "cs"), "short").join(value.withColumnRenamed("term", "long").withColumnRenamed("cvalue", "cl"), "long")
    threats = written(threats.filter((F.col("cl") > 0) & (F.col("cs") < ratio * F.col("cl"))).select("short", "long"), "nested")
    gone = threats.select(F.col("short").alias("term")).limit(0)
    open_ = threats
    while not open_.isEmpty():
        # Nothing open can remove these: they stay, and what they hold goes.
        stays = open_.select(F.col("long").alias("term")).distinct().join(open_.select(F.col("short").alias("term")).distinct(), "term", "left_anti")
        out = written(open_.join(stays.withColumnRenamed("term", "long"), "long", "left_semi").select(F.col("short").alias("term")).distinct(), "nested-gone")
        gone = gone.unionByName(out)
        left = open_.join(stays.withColumnRenamed("term", "long"), "long", "left_anti")
        left = left.join(out.withColumnRenamed("term", "short"), "short", "left_anti").join(out.withColumnRenamed("term", "long"), "long", "left_anti")
        open_ = written(left, "nested")
    return scores.join(gone.distinct(), "term", "left_anti")


def _islands(tokens: DataFrame, joins: Column) -> DataFrame:
    """Tokens that join, with island: the same number for those in one run. tokens: doc_id, sent_id, pos, surface, ..."""
    order = Window.partitionBy("doc_id", "sent_id").orderBy("pos")
    marked = tokens.withColumn("joins", F.coalesce(joins, F.lit(False)))
    return marked.withColumn("island", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order)).filter("joins")


def _run(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_id, island, parts (the surfaces in order), start."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "surface"))), lambda x: x["surface"])
    return tokens.groupBy("doc_id", "sent_id", "island").agg(parts.alias("parts"), F.min("pos").alias("start"))


def _noun() -> Column:
    return F.col("pos_major") == "noun"


def noun_runs(tokens: DataFrame, longest: int = 15) -> DataFrame:
    """Runs of nouns and prefixes in token order as compounds of two and more, up to a length in characters.

    tokens: doc_id, sent_id, pos, surface, pos_major, pos_sub. A number ends a run unless a counter follows it."""
    order = Window.partitionBy("doc_id", "sent_id").orderBy("pos")
    joins = F.col("pos_major").isin("noun", "prefix") & (~F.col("pos_sub").eqNullSafe("number") | (F.lead("pos_sub").over(order) == "counter"))
    runs = _run(_islands(tokens, joins)).select("doc_id", "sent_id", "start", F.size("parts").cast("long").alias("size"), F.array_join("parts", "").alias("term"))
    return runs.filter((F.col("size") >= 2) & (F.length("term") <= longest))


def noun_ngrams(tokens: DataFrame, low: int = 2, high: int = 6) -> DataFrame:
    """doc_id, sent_id, start, size, term of all runs of low..high tokens within runs of nouns and prefixes, valid ones (F6) alone."""
    runs = _run(_islands(tokens, F.col("pos_major").isin("noun", "prefix")))
    of = lambda n: F.when(F.size("parts") >= n, F.transform(F.sequence(F.lit(0), F.size("parts") - n), lambda i: F.struct((F.col("start") + i).alias("start"), F.lit(n).cast("long").alias("size"), F.array_join(F.slice("parts", i + 1, F.lit(n)), "").alias("term"))))
    grams = F.filter(F.flatten(F.array_compact(F.array(*(of(n) for n in range(low, high + 1))))), lambda g: T.is_valid_term(g["term"]))
    return runs.select("doc_id", "sent_id", F.explode(grams).alias("g")).select("doc_id", "sent_id", "g.*")


def single_nouns(tokens: DataFrame) -> DataFrame:
    """doc_id, term, n of nouns of two characters and more that are valid (F6); tokens are those of the analyser's longest units."""
    kept = tokens.filter(_noun() & (F.length("surface") >= 2) & T.is_valid_term(F.col("surface")))
    return kept.groupBy("doc_id", F.col("surface").alias("term")).agg(F.count("*").alias("n"))


def noun_subruns(tokens: DataFrame, most: int = 4, shortest: int = 2, longest: int = 20, minimum: int = 2) -> DataFrame:
    """Term and frequency of all sub-runs of up to `most` nouns, by length in characters, found `minimum` times and more."""
    runs = _run(_islands(tokens, _noun()))
    of = lambda n: F.when(F.size("parts") >= n, F.transform(F.sequence(F.lit(1), F.size("parts") - n + 1), lambda i: F.array_join(F.slice("parts", i, F.lit(n)), "")))
    terms = runs.select(F.explode(F.flatten(F.array_compact(F.array(*(of(n) for n in range(1, most + 1)))))).alias("term"))
    kept = terms.filter(F.length("term").between(shortest, longest)).groupBy("term").agg(F.count("*").alias("frequency"))
    return kept.filter(F.col("frequency") >= minimum)


def noun_phrases(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_id, start, phrase: each run of two nouns and more."""
    runs = _run(_islands(tokens, _noun())).filter(F.size("parts") >= 2)
    return runs.select("doc_id", "sent_id", "start", F.array_join("parts", "").alias("phrase"))


def keywords(tokens: DataFrame, shortest: int = 2, longest: int = 10, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and keyword, distinct: nouns in normal form, and runs of several nouns up to a length. tokens also has normalized."""
    runs = _run(_islands(tokens.withColumn("surface", F.col("normalized")), _noun()))
    one = F.filter("parts", lambda x: (F.length(x) >= shortest) & ~x.isin(*stop_words) if stop_words else F.length(x) >= shortest)
    whole = F.array_join("parts", "")
    return runs.select("doc_id", F.explode(F.concat(one, F.when((F.size("parts") > 1) & (F.length(whole) <= longest), F.array(whole)).otherwise(F.array().cast("array<string>")))).alias("keyword")).distinct()


#: Patterns of terms: bracketed abbreviations, models and codes, compounds of chemistry, abbreviations and what is
#: built with them, numbers with units, katakana with letters, technical compounds.
PATTERNS = (
    r"[（(][A-Z]{2,5}[）)]",
    r"\b[0-9]+[A-Z]+[-_][0-9]+[A-Z]*\b",
    r"\b[A-Z]+[0-9]+[A-Z]+[-_]?[0-9]*\b",
    r"\b[0-9]+[A-Z]{2,}[-_]?[0-9]*\b",
    r"\b(CO2|NOx|SOx|PM2\.5|NH3|H2O|CH4|N2O)\b",
    r"\b[A-Z]{2,5}:\s*[A-Z]",
    r"\b[A-Z]{2,5}\b",
    r"(?<![A-Za-z0-9])[A-Z][0-9]{1,2}(?![A-Za-z0-9])",
    r"\b[A-Z]{2,5}(制御|装置|システム|方式|機能|技術|モード)\b",
    r"\b\d+(\.\d+)?\s*(mg|kg|kWh|MW|rpm|bar|°C|K|Pa|MPa|m³|L)/?\w*\b",
    r"[ァ-ヴー]+[A-Z0-9]+",
    r"[A-Z0-9]+[ァ-ヴー]+",
    r"[ァ-ヴー]+(燃料|エンジン|システム|装置|機構)",
    r"(高|低|新|旧|次世代|環境)[ァ-ヴー]+",
)


def pattern_terms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, term, start, end of what the patterns find in whole texts: brackets go, of "ABC: D" the part before the
    colon stays, and what F6 refuses goes. start and end are code points of the whole match; equal spans of a term come once.
    The patterns' word bounds are those of Unicode, so they are matched per Arrow batch."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        patterns = [re.compile(p) for p in PATTERNS]
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0), batch.column(1)):
                spans = {(m[0].strip("（）()").split(":")[0].strip(), *m.span()) for p in patterns for m in p.finditer(t.as_py() or "")}
                rows += [(d.as_py(), *s) for s in spans]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["doc_id", "term", "start", "end"])

    found = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, term string, start bigint, end bigint")
    return found.filter(T.is_valid_term(F.col("term")))


def funnel(stages: DataFrame) -> DataFrame:
    """Stages has term, stage_index, stage, present. Terms that remain at each stage and those lost since the one before."""
    n = stages.groupBy("stage_index", "stage").agg(F.count_if("present").alias("remaining"))
    total = stages.agg(F.countDistinct("term").alias("total"))
    # One row for each stage: a handful, so one window over all is small.
    before = F.lag("remaining").over(Window.orderBy("stage_index"))
    return n.crossJoin(F.broadcast(total)).withColumn("dropped", F.coalesce(before, F.col("total")) - F.col("remaining")).select("stage_index", "stage", "remaining", "dropped")


def dropout_stage(stages: DataFrame) -> DataFrame:
    """The first stage at which each term is absent after it was present, or absent from the start; null if never."""
    order = Window.partitionBy("term").orderBy("stage_index")
    lost = stages.withColumn("was", F.coalesce(F.lag("present").over(order), F.lit(True))).groupBy("term").agg(F.min(F.when(~F.col("present") & F.col("was"), F.col("stage_index"))).alias("lost_at"))
    return lost
