"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A seed is the words that a mask picks from SPAN words in a row; the positions that it ignores may be substituted. Seeds
of the benchmark meet those of the documents in a join. Around each hit the texts are laid side by side, and a stretch of
up to OVERLAP words that holds the seed must agree in MIN_SHARE of its words. With LIGHT, no such stretch of SPAN words
and more is without a seed (the tests count all placements of up to 4 substitutions in 20 words and 20 per cent in 12 to
19); MASKS alone miss 11 per cent of the stretches of 20 words with 4 substitutions and up to 73 per cent of shorter ones.
Not sought: words put in or left out within a stretch, and stretches of fewer than SPAN words. Items of fewer than SPAN words, SHORT at
least, are sought as a run of their own length, all words alike; still shorter ones, null and empty ones are never found.

Words are runs of letters, digits and everything outside ASCII, in lower case. Null and empty texts have none. Items
of equal words are sought once and reported each. Documents with equal id and text are reported as one; null ids are ids like
others. Empty tables give an empty one; columns other than those named are not looked at; a long text takes room in
proportion in its task.

Documents are read once, for masks of all lengths together. Up to BROADCAST_SEEDS benchmark seeds are broadcast with the words
around them. Beyond, the bare seeds are (of more than FILTER_SEEDS, what they leave modulo that), and only what may be a hit
goes to a shuffle with the words around it. Benchmark places with equal seed and words around are compared once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN, OVERLAP, MIN_SHARE, SHORT = 12, 20, 80, 5
#: 1: the word counts; 0: any word may stand there. Each has eight ones.
MASKS = ("111011001011", "110100111011", "101110110101")
#: Six ones each: the fewest found of this weight that leave no stretch without a seed beside MASKS.
LIGHT = ("110010000111", "110001101100", "010101010011", "001011010110", "011110011000", "000101101011")
#: About 300 bytes each.
BROADCAST_SEEDS = 200_000
#: About 24 bytes each.
FILTER_SEEDS = 1 << 21
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")


def _hashed(df: DataFrame, text: str) -> Column:
    return F.transform(words_of(df[text]), lambda w: F.xxhash64(w))


def _places(df: DataFrame, keep: list[str], words: str, least: int, at: str) -> DataFrame:
    """A row for each position `at` of the array of word hashes from which `least` words are left."""
    # The outer form, because Spark would infer a filter from explode() and compute the words or the seeds twice for it.
    starts = F.when(F.size(words) >= least, F.sequence(F.lit(0), F.size(words) - least))
    return df.select(*keep, words, F.explode_outer(starts).alias(at)).filter(F.col(at).isNotNull())


def _seeds(places: DataFrame, keep: list[str], words: str, picks: list[str], at: str, whole=None, around: bool = True) -> DataFrame:
    """A row for each mask that fits at each position: keep, at, pick (the mask's number), seed and, with around, near, the words
    around: lead words before the seed, the seed and what follows, as many as a comparison may need."""
    left = F.size(words) - F.col(at)
    hashes = [F.when((left >= len(m)) & (F.lit(True) if whole is None else whole(len(m))), F.xxhash64(F.lit(f"{len(m)}:{m}"), *(F.get(words, F.col(at) + i) for i, c in enumerate(m) if c == "1"))) for m in picks]
    lead = F.least(F.col(at), F.lit(OVERLAP - SHORT))
    # The whole array ends here: a row that a join lets through has the words around alone.
    near = [lead.alias(f"lead_{at}"), F.slice(words, F.col(at) - lead + 1, lead + OVERLAP).alias(f"near_{at}")] if around else []
    names = [f"lead_{at}", f"near_{at}"] if around else []
    places = places.select(*keep, at, *near, F.array(*hashes).alias("seeds"))
    return places.select(*keep, at, *names, F.posexplode_outer("seeds").alias("pick", "seed"))


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, light: tuple[str, ...] = LIGHT, min_share: int = MIN_SHARE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS, filter_seeds: int = FILTER_SEEDS) -> DataFrame:
    """doc_id, text_key, item_id, n_hits (pairs of places with a seed around which an overlap was found), share (best, in
    hundredths), first_word (where the first stretch begins that agrees enough)."""
    span = len(masks[0])
    d = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("text_key"), _hashed(docs, text).alias("dw"))
    items = benchmark.select(benchmark[item_id].alias("item_id"), _hashed(benchmark, item_text).alias("iw")).filter(F.size("iw") >= SHORT)
    # Items of equal words are one class; the ids come back at the end.
    classes = items.select(F.xxhash64("iw").alias("class"), "iw", F.size("iw").alias("size")).dropDuplicates(["class"])
    shapes = classes.agg(F.sum(F.when(F.col("size") >= span, F.col("size") - span + 1)).alias("seeds"), F.count_if(F.col("size") < span).alias("few"), F.collect_set(F.when(F.col("size") < span, F.col("size"))).alias("short")).first()
    picks = [*masks, *light, *("1" * n for n in sorted(shapes["short"]))]
    least = min(map(len, picks))
    # A mask of SPAN words is for long items, a shorter one for items of just its length.
    seeds = _seeds(_places(classes, ["class", "size"], "iw", least, "q"), ["class", "size"], "iw", picks, "q", lambda n: (F.col("size") >= span) if n == span else (F.col("size") == n))
    seeds = seeds.filter("seed is not null").groupBy("seed", "pick", "lead_q", "near_q").agg(F.collect_list("class").alias("classes"))
    places = _places(d, ["doc_id", "text_key"], "dw", least, "p")
    sought = _seeds(places, ["doc_id", "text_key"], "dw", picks, "p").drop("pick")
    n = (shapes["seeds"] or 0) * len(masks + light) + shapes["few"]
    if n <= broadcast_seeds:
        hits = sought.join(F.broadcast(seeds), "seed")
    else:
        known = F.col("seed") if n <= filter_seeds else F.pmod("seed", F.lit(filter_seeds))
        maybe = F.broadcast(seeds.select(known.alias("known")).distinct())
        hits = sought.filter("seed is not null").join(maybe, known == maybe["known"], "left_semi").join(seeds, "seed")
    length = F.get(F.array(*(F.lit(len(m)) for m in picks)), F.col("pick"))
    found = _compared(hits.withColumn("room", F.lit(OVERLAP) - length), min_share)
    # Judged here and not before: a filter above would become part of the join's condition and end its generated code.
    good = F.col("share") >= min_share
    best = found.groupBy("doc_id", "text_key", "class").agg(F.count_if(good).alias("n_hits"), F.max("share").alias("share"), F.min(F.when(good, F.col("first_word"))).alias("first_word")).filter(good)
    return best.join(items.select("item_id", F.xxhash64("iw").alias("class")), "class").select("doc_id", "text_key", "item_id", "n_hits", "share", "first_word")


def _compared(hits: DataFrame, min_share: int) -> DataFrame:
    """The share of words, in hundredths, in which the best stretch around each hit agrees."""
    # Words before the seed and from it on that both texts have.
    before = F.least("lead_q", "lead_p", "room")
    after = F.least(F.size("near_q") - F.col("lead_q"), F.size("near_p") - F.col("lead_p"))
    part = lambda x: F.slice(f"near_{x}", F.col(f"lead_{x}") - before + 1, before + after)
    side = hits.select("doc_id", "text_key", "classes", (F.col("p") - before).cast("long").alias("first_word"), part("q").alias("a"), part("p").alias("b"))
    side = side.withColumn("same", F.zip_with("a", "b", lambda x, y: F.when(x == y, 1).otherwise(0))).drop("a", "b")
    size = F.least(F.size("same"), F.lit(OVERLAP))
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - size + 1), lambda s: F.aggregate(F.slice("same", s, size), F.lit(0), lambda x, y: x + y))
    side = side.withColumn("shares", F.transform(sums, lambda x: F.floor(x * 100 / size).cast("long")))
    begin = F.array_position(F.transform("shares", lambda x: x >= min_share), True) - 1
    return side.select("doc_id", "text_key", F.array_max("shares").alias("share"), (F.col("first_word") + begin).alias("first_word"), F.explode("classes").alias("class"))


def sql(min_share: int = MIN_SHARE) -> str:
    """DuckDB SQL for doc_id, item_id, n_hits, share and first_word; documents have distinct ids."""
    split = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

    def seeds(table: str, key: str, w: str, at: str) -> str:
        parts = []
        for m in MASKS + LIGHT:
            picked = ", ".join(f"{w}[{at} + {i + 1}]" for i, c in enumerate(m) if c == "1")
            parts.append(f"SELECT {key}, {w}, {at}, concat_ws(' ', '{m}', {picked}) AS seed FROM (SELECT *, unnest(range(len({w}) - {SPAN - 1})) AS {at} FROM {table} WHERE len({w}) >= {SPAN})")
        lengths = f"SELECT DISTINCT len(iw) AS n FROM i WHERE len(iw) BETWEEN {SHORT} AND {SPAN - 1}"
        parts.append(f"SELECT {key}, {w}, {at}, array_to_string(list_slice({w}, {at} + 1, {at} + n), ' ') || ' ' || n AS seed FROM (SELECT *, unnest(range(len({w}) - n + 1)) AS {at} FROM {table}, ({lengths}) WHERE len({w}) >= n{' AND len(iw) = n' if w == 'iw' else ''})")
        return " UNION ALL ".join(parts)

    return f"""
WITH d AS (SELECT doc_id, {split} AS dw FROM documents), i AS (SELECT item_id, {split} AS iw FROM benchmark),
h AS (SELECT *, CASE WHEN len(iw) >= {SPAN} THEN {SPAN} ELSE len(iw) END AS span FROM ({seeds("d", "doc_id", "dw", "p")}) JOIN ({seeds("i", "item_id", "iw", "q")}) USING (seed)),
s AS (SELECT *, least(q, p, {OVERLAP} - span) AS bef, least(len(iw) - q, len(dw) - p, {OVERLAP}) AS aft FROM h),
m AS (SELECT doc_id, item_id, p - bef AS first_word, list_transform(range(bef + aft), lambda k: (iw[q - bef + 1 + k] = dw[p - bef + 1 + k])::INT) AS same FROM s),
v AS (SELECT doc_id, item_id, first_word, list_transform(range(len(same) - least(len(same), {OVERLAP}) + 1), lambda k: floor(list_sum(list_slice(same, k + 1, k + least(len(same), {OVERLAP}))) * 100 / least(len(same), {OVERLAP}))::BIGINT) AS shares FROM m),
w AS (SELECT doc_id, item_id, list_max(shares) AS share, first_word + list_position(list_transform(shares, lambda x: x >= {min_share}), true) - 1 AS first_word FROM v)
SELECT doc_id, item_id, count(*) AS n_hits, max(share) AS share, min(first_word)::BIGINT AS first_word FROM w WHERE share >= {min_share} GROUP BY ALL"""
