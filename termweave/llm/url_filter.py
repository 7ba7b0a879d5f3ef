"""URL filter: fixed host and path rules first; FP-growth mines token combinations of labelled URLs for the rest.

Tokens that stand in the very same labelled URLs are one class, and a rule is made of classes: it fits a URL that has a token
of each. So one long URL that many pages share makes one item, not a power of two of itemsets, and no rule is lost. A class
whose URLs all have one verdict is a rule by itself and in no longer one, which would say no more. What is left can
still be many itemsets where many tokens come together in ever other ways under both verdicts.

Labels come from elsewhere than the fixed rules: by_title() takes the share of symbols in a page's title. Null URLs and URLs
without :// have an empty host and path, fit no rule and have no tokens; the default verdict holds for them, as for every URL
that no mined rule fits. Rows stay one to one, also repeated ones or null page_id. Empty tables give an empty one, empty labels
no mined rule; columns other than those named are not looked at. Of rules that fit, ties go by confidence, support, size, name.
"""

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
LABEL = "label="
#: Up to which size of their strings tables are broadcast.
BROADCAST_BYTES = 8 << 20
#: Token sets of more than this part of the pages are frequent; there are fewer than this many.
HOT_SHARE = 10_000


@dataclass(frozen=True)
class Rule:
    """Fits the host itself and its subdomains where the path starts with this path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values.
BASE_RULES = (Rule(ALLOW, "org", "/"), Rule(BLOCK, "example.org", "/es/"), Rule(BLOCK, "example.org", "/en/1"), Rule(ALLOW, "com", "/fr/"), Rule(BLOCK, "com", "/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(url, F.lit(""))
    at = F.instr(known, "://")
    rest = F.when(at > 0, F.substr(known, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def _first_fitting(rules: tuple[Rule, ...], give) -> Column:
    """The longest rule that fits: a short fixed list compiles into one CASE."""
    fits = lambda r: ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
    return F.coalesce(*(F.when(fits(r), F.lit(give(r))) for r in sorted(rules, key=lambda r: -len(r.name))), F.lit(None).cast("string"))


def url_tokens() -> Column:
    """Distinct tokens of host and path: labels of the host, its parts between hyphens, path segments (digits as N)."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    parts = F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: x != "")
    segments = F.filter(F.split(F.regexp_replace("path", "[0-9]+", "N"), "/"), lambda x: x != "")
    tag = lambda name, xs: F.transform(xs, lambda x: F.concat(F.lit(name), x))
    top = F.when(F.size(labels) > 0, F.array(F.concat(F.lit("top="), F.element_at(labels, -1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(top, tag("host=", parts), tag("path=", segments)))


def by_title(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url and verdict of the pages with a title: block where more than a tenth of its characters are symbols."""
    title = F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)
    symbols = F.length(title) - F.length(F.translate(title, "#*$%&|<>", ""))
    verdict = F.when(10 * symbols > F.length(title), BLOCK).when(F.length(title) > 0, ALLOW)
    return pages.select(pages[url].alias("url"), verdict.alias("verdict")).filter("verdict is not null")


def token_classes(labelled: DataFrame, min_support: float) -> tuple[DataFrame, DataFrame]:
    """token and class (its least token) of the tokens in at least min_support of the URLs, and class and verdict of the classes that
    have one verdict alone. labelled: tokens (distinct), verdict, n (URLs that have just these).

    Tokens have one class if the hashes of the token sets that hold them add up alike; of the sums, one is 96 bits wide."""
    total = labelled.filter(F.size("tokens") > 0).agg(F.sum("n")).first()[0] or 0
    one = F.xxhash64("tokens", "verdict")
    each = labelled.select(F.explode("tokens").alias("token"), "verdict", "n", one.alias("h"))
    found = each.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("h").cast("decimal(29,0)")).alias("s"), F.bit_xor("h").alias("x"), F.min("verdict").alias("low"), F.max("verdict").alias("high"))
    often = found.filter(F.col("n") >= min_support * total)
    first = often.groupBy("n", "s", "x").agg(F.min("token").alias("class"), F.first("low").alias("low"), F.first("high").alias("high"))
    tokens = written(often.join(first.select("n", "s", "x", "class"), ["n", "s", "x"]).select("token", "class"), "url-tokens")
    return tokens, first.filter("low = high").select("class", F.col("low").alias("verdict"))


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """token and class of the frequent tokens; and id, classes, verdict, confidence, support, key of the rules. labelled has tokens
    and verdict.

    A rule goes when a part of it says the same with no less confidence. key is the rule's class in the fewest rules.
    """
    sets = written(labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n")), "url-labels")
    tokens, pure = token_classes(sets, min_support)
    pure = written(pure, "url-pure")
    total = sets.filter(F.size("tokens") > 0).agg(F.sum("n")).first()[0] or 1
    # Each token stands in min_support of the URLs at least, so there are at most 1 / min_support times the tokens of a URL.
    mixed = tokens.join(pure.select("class"), "class", "left_anti")
    items = sets.withColumn("set", F.xxhash64("tokens", "verdict")).select("set", "verdict", "n", F.explode("tokens").alias("token")).join(_small(mixed, "token"), "token")
    items = items.groupBy("set", "verdict", "n").agg(F.collect_set("class").alias("classes")).select(F.concat("classes", F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"), "n")
    # FP-growth counts rows, so a set stands once for each of its URLs.
    items = items.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("items")
    rows = items.count()
    share = min(1.0, min_support * total / rows) if rows else 1.0
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(items)
    found = model.associationRules.filter(F.startswith(F.col("consequent")[0], F.lit(LABEL))).filter(F.col("support") * rows >= min_support * total)
    found = found.select(F.array_sort("antecedent").alias("classes"), F.substr(F.col("consequent")[0], F.lit(len(LABEL) + 1)).alias("verdict"), "confidence", (F.col("support") * rows / total).alias("support"))
    counts = sets.select(F.explode("tokens").alias("class"), "n").groupBy("class").agg(F.sum("n").alias("n"))
    alone = pure.join(counts, "class").select(F.array("class").alias("classes"), "verdict", F.lit(1.0).alias("confidence"), (F.col("n") / total).alias("support"))
    rules = written(found.unionByName(alone).withColumn("id", F.xxhash64("classes", "verdict")), "url-found")
    shorter = rules.select(F.explode("classes").alias("class"), F.col("classes").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    wider = rules.withColumn("class", F.explode("classes")).alias("r").join(shorter, "class").filter((F.col("v") == F.col("verdict")) & (F.size("part") < F.size("classes")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("part", "classes")) == 0))
    rules = rules.join(wider.select("id").distinct(), "id", "left_anti")
    keys = rules.select("id", F.explode("classes").alias("key"))
    rarest = keys.join(keys.groupBy("key").count(), "key").groupBy("id").agg(F.min_by("key", F.struct("count", "key")).alias("key"))
    return tokens, written(rules.join(rarest, "id"), "url-rules")


def _small(df: DataFrame, *names: str) -> DataFrame:
    """The table, for a broadcast if its strings (or arrays of strings) have at most BROADCAST_BYTES."""
    text = lambda c: F.array_join(c, " ") if df.schema[c].dataType.typeName() == "array" else F.col(c)
    size = df.agg(F.sum(sum((F.octet_length(text(c)) for c in names), F.lit(100)))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def judge(pages: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, labels: DataFrame | None = None, min_support: float = 0.01, min_confidence: float = 0.8, default: str = ALLOW, page_id: str = "page_id", url: str = "url", hot_share: int = HOT_SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict and, where a mined rule decided, mined (the URL's tokens that it asks for) and confidence.

    labels has url and verdict; without it nothing is mined and the default decides.
    Of several mined rules that fit, the one with most confidence, then support, then classes decides.
    """
    host, path = host_and_path(F.col(url))
    df = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    df = df.withColumn("rule", _first_fitting(rules, lambda r: r.name)).withColumn("fixed", _first_fitting(rules, lambda r: r.verdict)).withColumn("tokens", url_tokens()).drop("url")
    out = ["page_id", "host", "path", "rule"]
    none = {"mined": F.lit(None).cast("array<string>"), "confidence": F.lit(None).cast("double")}
    if labels is None:
        return df.select(*out, F.coalesce("fixed", F.lit(default)).alias("verdict")).withColumns(none)
    h, p = host_and_path(F.col("url"))
    labelled = labels.select("url", "verdict").filter("verdict is not null").withColumns({"host": h, "path": p}).select(url_tokens().alias("tokens"), "verdict")
    tokens, mined = mine(labelled, min_support, min_confidence)
    index = _small(mined.select("key", "classes", F.col("verdict").alias("mined_verdict"), "confidence", "support"), "classes")
    # A token set is looked up once, however many pages share it.
    rest = written(df.filter("fixed is null").groupBy("tokens").agg(F.count("*").alias("n_pages")), "url-token-sets")
    total = rest.agg(F.sum("n_pages")).first()[0] or 0
    known = rest.select("tokens", F.explode("tokens").alias("token")).join(_small(tokens, "token", "class"), "token")
    known = known.groupBy("tokens").agg(F.collect_list(F.struct("token", "class")).alias("known"))
    own = F.transform("known", lambda x: x["class"])
    fits = known.withColumn("own", F.array_distinct(own)).withColumn("key", F.explode("own")).join(index, "key").filter(F.size(F.array_except("classes", "own")) == 0)
    order = F.struct("confidence", "support", F.size("classes"), "classes")
    shown = F.array_sort(F.transform(F.filter("known", lambda x: F.array_contains("classes", x["class"])), lambda x: x["token"]))
    best = fits.withColumn("mined", shown).groupBy("tokens").agg(F.max_by(F.struct("mined", "mined_verdict", "confidence"), order).alias("best"))
    best = written(rest.join(best, "tokens", "left"), "url-verdicts")
    # Pages of a frequent set don't meet in one task: such sets are fewer than hot_share, so they go to the pages.
    hot = F.col("n_pages") * hot_share > total
    held = _small(best.filter(hot).select("tokens", F.struct("best").alias("held")), "tokens")
    marked = df.filter("fixed is null").join(held, "tokens", "left")
    few = marked.filter("held is null").drop("held").join(best.filter(~hot).select("tokens", "best"), "tokens", "left")
    undecided = marked.filter("held is not null").withColumn("best", F.col("held.best")).drop("held").unionByName(few)
    ruled = df.filter("fixed is not null").select(*out, F.col("fixed").alias("verdict")).withColumns(none)
    return ruled.unionByName(undecided.select(*out, F.coalesce("best.mined_verdict", F.lit(default)).alias("verdict"), F.col("best.mined").alias("mined"), F.col("best.confidence").alias("confidence")))
