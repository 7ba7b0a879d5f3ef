"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

A null text is an empty one, and has no spans. Spans are code points, end exclusive, in the order of KINDS and then by start. Every
step is linear in the text, whatever the text holds and however long it is. Rows stay one to one, also for repeated or null doc_id; an
empty table gives an empty one; columns other than the two named ones are not looked at, whatever they are called.
"""

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "national_phone")
#: These four are reported whatever their score; the others need THRESHOLD.
BASE = KINDS[:4]
THRESHOLD = 0.6
CONTEXT_CHARS = 40
#: Score without context, and words, also in the plural, that raise it when they stand shortly before.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.85, "phone": 0.7, "iban": 0.9, "secret": 0.5, "national_phone": 0.4}
CONTEXT = {
    "email": ("mail", "email", "contact"),
    "ip": ("address", "server", "host"),
    "card": ("card", "visa", "payment"),
    "phone": ("phone", "telephone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank"),
    "secret": ("token", "secret", "key", "password"),
    "national_phone": ("phone", "telephone", "call", "tel", "mobile", "fax"),
}
RAISE = 0.25
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is entered at its start alone: a later start in it fails or matches just the same.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?: ?[A-Z0-9]){11}")
_IBAN_REST = {n: re.compile(f"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
_WORD = re.compile("[a-z]+")
_SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,128}(?![0-9A-Za-z])")
_NATIONAL = re.compile(r"(?<![0-9+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part reaches back from an @ to the first other character, or to the end of the match before."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that their validator confirms."""
    yield from (("email", *x) for x in _emails(text))
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        # As many characters as the country's have: what follows after a blank is no part of it.
        size = IBAN_LENGTHS.get(m[1])
        if size and (rest := _IBAN_REST[size].match(text, m.start() + 4)) and mod_97(text[m.start() : rest.end()].replace(" ", "")):
            yield "iban", m.start(), rest.end()
    for m in _SECRET.finditer(text):
        yield "secret", *m.span()
    if "(" in text:
        for m in _NATIONAL.finditer(text):
            yield "national_phone", *m.span()


def _words_before(text: str, at: int) -> set[str]:
    """Words in lower case that end shortly before a place; the one at the window's start only if it is whole."""
    start = max(0, at - CONTEXT_CHARS)
    while 0 < start < at and text[start - 1].isalpha() and text[start].isalpha():
        start += 1
    return set(_WORD.findall(text[start:at].lower()))


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in the order of KINDS, then by start."""
    found = []
    for kind, start, end in _proposed(text or ""):
        before = _words_before(text, start)
        score = min(1.0, SCORES[kind] + RAISE * any(w in before or w + "s" in before for w in CONTEXT[kind]))
        if kind in BASE or score >= THRESHOLD:
            found.append((kind, start, end, score))
    taken = sorted((x[1], x[2]) for x in found if x[0] in BASE)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    # A span of another kind inside one that is already reported adds nothing. A span that starts no later and ends no
    # earlier holds it, so the farthest end so far tells.
    found = [x for x in found if x[0] in BASE or not (i := bisect_right(starts, x[1])) or reach[i - 1] < x[2]]
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def redacted(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first one names the place."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end, score) and the redacted text, a row for each row of docs."""
    kind = docs.schema[doc_id].dataType

    def run(batches):
        for batch in batches:
            texts = column(batch, "text")
            spans = [find_spans(x) for x in texts]
            fields = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
            rows = pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in x] for x in spans], pa.list_(fields))
            clean = pa.array([redacted(t, s) for t, s in zip(texts, spans)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, clean], ["doc_id", "spans", "redacted"])

    picked = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>, redacted string")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span in the text replaced by its kind; the other columns stay."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            clean = [redacted(t, find_spans(t)) for t in column(batch, text)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, a count of each base kind, base_sha256 and spans, from the spans that scan() gives."""
    found = scan(docs)

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"))
