"""Text as columns: normalising, splitting, predicates and the parsers of loosely formatted answers.

Everything stays in the JVM but nfkc(), which rows that are pure ASCII skip. Null in, null out, unless said otherwise.
"""

import unicodedata
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Ranges of kana, kanji, their punctuation and half-width forms.
JAPANESE = r"々-〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
CJK_MARKS = r"　-〿"


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    # One text is a string at a time, as a batch may hold thousands of long ones.
    return pa.array((None if (t := x.as_py()) is None else unicodedata.normalize("NFKC", t) for x in text), pa.string())


def nfkc(text: Column) -> Column:
    """Functions in Python are run on all rows, whatever stands round them, so texts that stay as they are go there as nulls."""
    ascii = text.rlike(r"^\p{ASCII}*$")
    return F.when(ascii, text).otherwise(_nfkc(F.when(~ascii, text)))


#: The characters beside which blanks go, and those round which they go.
SOLID_JAPANESE, SOLID_MARKS = "ぁ-んァ-ヴー一-龠", "（()）、。，．:"


def normalized(text: Column, compatibility: bool = True) -> Column:
    """NFKC; no blanks round line breaks; a tab is a blank, blanks are single, two line breaks at most; no blank beside Japanese
    characters, nor round round brackets, 、。，． and the colon; no white space at the ends. Tabs round line breaks stay as blanks."""
    out = nfkc(text) if compatibility else text
    steps = ((" *\n *", "\n"), (r"\t", " "), (" {2,}", " "), (r"\n{3,}", "\n\n"), (f"(?<=[{SOLID_JAPANESE}]) | (?=[{SOLID_JAPANESE}])", ""), (f" *([{SOLID_MARKS}]) *", "$1"))
    for pattern, new in steps:
        out = F.regexp_replace(out, pattern, new)
    return stripped(out)


#: White space of any script, for a character class.
BLANKS = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_BLANK_CHARACTERS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: The characters beside which a page reader's blanks go.
LAYOUT_JAPANESE = "ぁ-んァ-ヴー一-龠々〆〤"


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(text, F.lit(_BLANK_CHARACTERS))


def cleaned_layout(text: Column) -> Column:
    """Page text without blanks round line breaks and without those beside Japanese characters."""
    out = F.regexp_replace(text, " *\n *", "\n")
    out = F.regexp_replace(out, f" +([{LAYOUT_JAPANESE}])", "$1")
    return F.regexp_replace(out, f"([{LAYOUT_JAPANESE}]) +", "$1")


def tokens(text: Column) -> Column:
    """X2 without an analyser: words between white space."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


#: Where a sentence ends; the strict form also breaks at quotes and commas.
SENTENCE_END, STRICT_END = r"[。！？\n]+", r"[。！？\n「」『』、]+"


def sentences(text: Column, strict: bool = False) -> Column:
    """Split at 。！？ and line breaks, blank pieces go; strict also at 「」『』、, and pieces below three characters go.

    A blank after 。！？ needs no rule of its own, as the break stands before it and pieces are stripped."""
    pieces = F.transform(F.split(text, STRICT_END if strict else SENTENCE_END), stripped)
    return F.filter(pieces, lambda x: F.length(x) >= (3 if strict else 1))


def word_set(text: Column) -> Column:
    """Distinct lower-case words of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 when both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def occurrences(text: Column, term: Column) -> Column:
    """Times that a term stands in a text without overlap; 0 for an empty term."""
    return F.coalesce(F.try_divide(F.length(text) - F.length(F.replace(text, term, F.lit(""))), F.length(term)), F.lit(0.0)).cast("long")


def context(text: Column, term: Column, window: int = 100) -> Column:
    """The term and the characters around its first place; null where it is missing."""
    at = F.instr(text, term)
    start = F.greatest(at - window, F.lit(1))
    return F.when(at > 0, F.concat(term, F.lit(": "), F.substr(text, start, at - start + F.length(term) + window)))


def is_japanese(text: Column) -> Column:
    """F12."""
    return text.rlike(f"[{JAPANESE}{CJK_MARKS}]")


def is_code(term: Column) -> Column:
    """letter and digit, only A-Z, a-z, 0-9, - _ ., 2 to 15 characters."""
    return term.rlike(r"^[A-Za-z0-9._-]{2,15}$") & term.rlike("[A-Za-z]") & term.rlike("[0-9]")


def is_abbreviation(term: Column, strict: bool = False) -> Column:
    """F8: two to five capitals, then (not if strict) a digit or x."""
    return term.rlike("^[A-Z]{2,5}$" if strict else "^[A-Z]{2,5}[0-9x]?$")


#: Numbered pages, figures, tables, equations, versions, chapters and sections.
NUMBERED = (r"^[pP]\p{Nd}+$", r"^[pP][pP]\p{Nd}+$", r"^[fF]ig\p{Nd}+$", r"^[tT](able|bl)\p{Nd}+$", r"^[eE]q\p{Nd}+$", r"^[vV]\p{Nd}*$", r"^[vV]er\p{Nd}*$", r"^[nN]o\.?\p{Nd}+$", r"^[cC]h\p{Nd}+$", r"^[sS]ec\p{Nd}+$")
#: Particles and auxiliary verbs, which are no term by themselves.
PARTICLES = (
    "の", "に", "が", "を", "は", "で", "と", "から", "まで", "より",
    "へ", "や", "も", "て", "ば", "ない", "だ", "です", "ます", "である",
)
#: Tag names.
TAG_NAMES = (
    "div", "span", "img", "svg", "td", "tr", "th", "tbody", "thead", "table",
    "ul", "ol", "li", "br", "hr", "pre", "code", "html", "body", "head",
    "meta", "link", "script", "style", "form", "input", "button", "label",
    "select", "option", "iframe", "nav", "header", "footer", "section",
    "article", "aside", "main", "figure", "figcaption", "video", "audio",
    "source", "canvas", "embed", "object", "param", "a", "p", "h1", "h2",
    "h3", "h4", "h5", "h6", "strong", "em", "b", "i", "u", "s", "small",
)
#: Words too general to be a term.
GENERAL_WORDS = (
    "エリア", "モード", "こと", "もの", "ため", "よう", "など",
    "について", "により", "における", "として", "による",
    "それ", "これ", "あれ", "その", "この", "あの",
    "とき", "とこ", "ところ", "ほか", "さらに", "また", "および",
    "and", "the", "of", "in", "for", "with", "from", "to", "at", "by",
    "stage", "fig", "figure", "table", "exterior", "interior", "single",
    "system", "Fig", "Table", "Stage", "System", "Exterior", "Interior", "Single",
    "page", "Page", "ref", "Ref", "reference", "Reference",
    "ver", "version", "Ver", "Version", "chapter", "Chapter", "section", "Section",
    "システ", "インタ", "クーラ", "アシスト", "モータ", "ロータ",
    "タービン", "コンプレッサ", "スタック", "カモータ",
    "図", "表", "式",
)
_MARKS = r"!-/:-@\[-`{-~"
#: Reasons to refuse a term that is no code, as patterns: a numbered figure in it, kana alone, marks alone, a mark or a digit in front.
REFUSED = (r"第\p{Nd}+[図表式]", "^[ぁ-ん]+$", f"^[{_MARKS}{BLANKS}]+$", f"^[{_MARKS}、。，．・「」『』（）{BLANKS}]", r"^[\p{Nd}.]")


def is_valid_term(term: Column) -> Column:
    """F6 without the word classes, which an analyser would have to give: the first rule that applies decides.

    Numbered pages and the like go, codes stay, then less than three characters, the words and the forms above go. A mark
    at the end of a longer term is no reason. Abbreviations of two letters fall to the length."""
    any_of = lambda patterns: reduce(or_, (term.rlike(p) for p in patterns))
    return (
        F.when(term == "", False)
        .when(any_of(NUMBERED), False)
        .when(is_code(term), True)
        .when((F.length(term) < 3) | term.isin(*PARTICLES) | F.lower(term).isin(*TAG_NAMES) | any_of(REFUSED) | term.isin(*GENERAL_WORDS), False)
        .otherwise(True)
    )


#: Two to five capitals.
ACRONYM = "^[A-Z]{2,5}$"


def morphology(term: Column) -> Column:
    """The class of a term by its characters."""
    n = F.length(term)
    return F.when(term.rlike(ACRONYM), "acronym").when(term.rlike(r"\p{Nd}"), "numeric").when(n == 1, "single_char").when(n <= 3, "short_compound").when(n <= 6, "medium_compound").otherwise("long_compound")


def category(term: Column, frequency: Column) -> Column:
    """As X14, but by frequency where X14 goes by length."""
    return F.when(term.rlike(ACRONYM), "acronym").when(term.rlike(r"\p{Nd}"), "numeric").when(F.length(term) == 1, "single_char").when(frequency >= 3, "high_freq_compound").otherwise("low_freq_compound")


def key_phrases(text: Column) -> Column:
    """Distinct phrases of a definition: what stands in round brackets (two characters and more), the first phrase up
    to 、。， without its copula (three and more), and multiples or percentages."""
    bracketed = F.regexp_extract_all(text, F.lit(r"（[^）]+）|\([^)]+\)"), F.lit(0))
    inside = F.filter(F.transform(bracketed, lambda x: F.substr(x, F.lit(2), F.length(x) - 2)), lambda x: F.length(x) > 1)
    first = F.regexp_replace(stripped(F.regexp_extract(text, "^([^、。，]+)[、。，]", 1)), "(とは|は|です|である)$", "")
    first = F.filter(F.array(first), lambda x: F.length(x) > 2)
    numbers = F.regexp_extract_all(text, F.lit(r"\p{Nd}+[倍％%]"), F.lit(0))
    return F.array_distinct(F.concat(inside, first, numbers))


def partial_confidence(key: Column, query: Column) -> Column:
    """X18, of which one contains the other: 0.7 times the share of the longer string that matches; a fifth more, up to
    0.95, where the key stands in the query between word bounds."""
    ratio = F.try_divide(F.when(F.contains(query, key), F.length(key)).otherwise(F.length(query)), F.greatest(F.length(key), F.length(query)))
    quoted = F.concat(F.lit(r"\Q"), F.replace(key, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    whole = F.contains(query, key) & F.regexp_like(query, F.concat(F.lit(r"(?U)\b"), quoted, F.lit(r"\b")))
    return 0.7 * F.when(whole, F.least(ratio * 1.2, F.lit(0.95))).otherwise(ratio)


def json_in_prose(text: Column) -> Column:
    """The JSON object of an answer: without code fences as a whole, else the first {...} without nesting; or null."""
    bare = F.trim(F.regexp_replace(text, r"```(?:json)?", ""))
    inner = F.regexp_extract(bare, r"\{[^{}]*\}", 0)
    valid = lambda x: F.try_parse_json(x).isNotNull() & x.rlike(r"^\s*[\{\[]")
    return F.when(valid(bare), bare).when((inner != "") & valid(inner), inner)


def bits(text: Column, count: int) -> Column:
    """Booleans of "[1, 0, ...]", any other number counting as true, if their number is right; else the first `count` digits
    0 and 1 anywhere; all false if there are fewer, or if the list holds something between commas that is no number."""
    none = F.array_repeat(F.lit(False), count)
    parts = F.filter(F.transform(F.split(F.regexp_extract(text, r"\[([0-9,\s]+)\]", 1), ","), stripped), lambda x: x != "")
    digits = F.regexp_extract_all(text, F.lit("[01]"), F.lit(0))
    return (
        F.when(F.exists(parts, lambda x: ~x.rlike("^[0-9]+$")), none)
        .when(F.size(parts) == count, F.transform(parts, lambda x: x.rlike("[1-9]")))
        .when(F.size(digits) >= count, F.slice(F.transform(digits, lambda x: x == "1"), 1, count))
        .otherwise(none)
    )


def numbers(text: Column, count: int) -> Column:
    """The first whole numbers of a text, filled up with 0."""
    found = F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(found, F.array_repeat(F.lit(0), count)), 1, count)


_NUMBERED_LINE = r"^[0-9]+\.\s*(.+?):\s*(.+)$"


def numbered_lines(text: Column) -> Column:
    """(term, definition) of lines "n. term: definition"."""
    lines = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x.rlike(_NUMBERED_LINE))
    part = lambda x, i: stripped(F.regexp_extract(x, _NUMBERED_LINE, i))
    return F.transform(lines, lambda x: F.struct(part(x, 1).alias("term"), part(x, 2).alias("definition")))


def asked_definitions(text: Column, asked: Column) -> Column:
    """(term, definition) for the asked terms (array): a line answers the first asked term that holds its term or is
    held by it; of several lines for one term the last counts."""
    first = lambda line: F.get(F.filter(asked, lambda a: F.contains(line["term"], a) | F.contains(a, line["term"])), F.lit(0))
    matched = F.transform(numbered_lines(text), lambda line: F.struct(first(line).alias("term"), line["definition"].alias("definition")))
    last = lambda a: F.try_element_at(F.filter(matched, lambda m: m["term"] == a), F.lit(-1))
    return F.filter(F.transform(F.array_distinct(asked), last), lambda x: x.isNotNull())


def numbered_items(text: Column, most: int = 4) -> Column:
    """What follows "n." in each line."""
    return F.slice(F.regexp_extract_all(text, F.lit(r"[0-9]+\.\s*(.+)"), F.lit(1)), 1, most)


def jargon_runs(text: Column, most: int = 5) -> Column:
    """The first runs of kana, kanji, letters and digits of an answer."""
    return F.slice(F.regexp_extract_all(text, F.lit("[ぁ-んァ-ヴー一-龠a-zA-Z0-9]+"), F.lit(0)), 1, most)


#: Answers that mean that nothing fits.
NONE_WORDS = ("なし", "無し", "None", "none", "")


def chosen_indices(text: Column, count: int) -> Column:
    """Numbers 1..count of an answer as 0-based indices, with repeats; none for an answer that says none."""
    found = F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int") - 1)
    return F.when(stripped(text).isin(*NONE_WORDS), F.array().cast("array<int>")).otherwise(F.filter(found, lambda x: (x >= 0) & (x < count)))


def chunk_body(text: Column) -> Column:
    """what follows the first --- of a stored chunk."""
    at = F.instr(text, "---")
    return F.when(at > 0, F.trim(F.substr(text, at + 3))).otherwise(text)


def chunk_cell_body(text: Column) -> Column:
    """F14, of a cell of a result table: what follows the first line that ends in ---, else all but a first line "Source:...";
    stripped."""
    at = F.instr(text, "---\n")
    rest = F.when(F.startswith(text, F.lit("Source:")), F.regexp_replace(text, r"^[^\n]*\n?", "")).otherwise(text)
    return stripped(F.when(at > 0, F.substr(text, at + 4)).otherwise(rest))


def has_body(text: Column) -> Column:
    """whether anything is left without header lines."""
    return F.trim(F.regexp_replace(text, r"(?m)^#{1,6}\s.*$", "")) != ""


def chunk_number(chunk_id: Column) -> Column:
    """The number at the end of a chunk id; 999999 for other ids."""
    return F.coalesce(F.regexp_extract(chunk_id, r"_chunk_([0-9]+)$", 1).try_cast("int"), F.lit(999999))


def boosted(term: Column, confidence: Column) -> Column:
    """M8: term^confidence, with one decimal; a half goes up."""
    return F.concat(term, F.lit("^"), F.format_string("%.1f", confidence.cast("double")))


def weighted_query(query: Column, found: Column, least: float = 0.7, most: int = 3) -> Column:
    """M8: the query and, of its first `most` found terms (array of term, confidence), those above `least` as term^confidence;
    null where there are none."""
    sure = F.filter(F.slice(found, 1, most), lambda x: x["confidence"] > least)
    return F.when(F.size(sure) > 0, F.concat(query, F.lit(" "), F.array_join(F.transform(sure, lambda x: boosted(x["term"], x["confidence"])), " ")))


def combined_terms(forward: Column, found: Column, least: float = 0.5) -> Column:
    """The terms of the query and the found ones (array of term, confidence) above `least`, distinct and sorted."""
    return F.array_sort(F.array_union(forward, F.transform(F.filter(found, lambda x: x["confidence"] > least), lambda x: x["term"])))


def markdown_table(cells: Column) -> Column:
    """S3: rows of cells as a markdown table: line breaks become blanks, the first row is the header."""
    line = lambda row: F.concat(F.lit("| "), F.array_join(F.transform(row, lambda c: F.replace(c, F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(cells, F.lit(0)), lambda c: F.lit("---")), " | "), F.lit(" |"))
    lines = F.transform(cells, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n")


def context_block(chunks: Column) -> Column:
    """Chunks (array of chunk_id, content) as the context of a question, numbered from 1; a fixed text for none."""
    part = lambda c, i: F.concat(F.lit("[ソース "), (i + 1).cast("string"), F.lit(" ChunkID: "), F.coalesce(c["chunk_id"], F.lit("N/A")), F.lit("]\n"), c["content"])
    return F.when(F.size(chunks) > 0, F.array_join(F.transform(chunks, part), "\n\n")).otherwise("(コンテキスト無し)")


def source_list(documents: Column) -> Column:
    """Distinct names, sorted, with commas; a fixed word for missing ones."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(documents, lambda d: F.coalesce(d, F.lit("不明"))))), ", ")
