"""Markdown documents as chunks by header path and size. A document is cut in its task; nothing is shuffled."""

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import text as T

CHUNK_CHARS, OVERLAP = 1000, 0
#: Header levels that cut; deeper ones are text.
LEVELS = 4
#: What a section is cut at when it is too long: the first of them that it has, then the next within what is still too long.
CUTS = ("\n\n", "\n", " ", "")


def repaired(text: str) -> str:
    """Marks that follow any character but a line break begin a line, also those after another mark: "## B" becomes "#" and "# B".
    A blank follows marks at the start of a line."""
    out = re.sub("([^\n])(#{1,6})", r"\1\n\2", text)
    return re.sub(r"(?m)(^#{1,6})([^# \n])", r"\1 \2", out)


def sections(text: str) -> list[tuple[list[tuple[int, str]], str]]:
    """(level, name) of the headers above, outermost first, and the body of each section that has one. Lines are stripped, paragraphs
    are parted by two blanks and a line break, and nothing within a fence is a header. An empty name is a header too."""
    path: list[tuple[int, str]] = []
    out: list[tuple[list[tuple[int, str]], str]] = []
    lines: list[str] = []
    fence = ""

    def close() -> None:
        if lines:
            body = "\n".join(lines)
            if out and out[-1][0] == path:
                out[-1] = (path, f"{out[-1][1]}  \n{body}")
            else:
                out.append((path, body))
            lines.clear()

    for line in text.split("\n"):
        line = "".join(c for c in line.strip() if c.isprintable())
        if fence:
            fence = "" if line.startswith(fence) else fence
            lines.append(line)
            continue
        if line.startswith("```") and line.count("```") == 1:
            fence = "```"
        elif line.startswith("~~~"):
            fence = "~~~"
        if fence:
            lines.append(line)
        elif m := re.match(rf"(#{{1,{LEVELS}}})(?: (.*))?$", line):
            close()
            level = len(m[1])
            path = [x for x in path if x[0] < level] + [(level, (m[2] or "").strip())]
        elif line:
            lines.append(line)
        else:
            close()
    close()
    return out


def _together(parts: list[str], size: int, overlap: int) -> list[str]:
    """Neighbours put together as far as size allows; the last ones, up to overlap, begin the next piece too."""
    out, now, total = [], [], 0
    for part in parts:
        if now and total + len(part) > size:
            out.append("".join(now).strip())
            while now and (total > overlap or total + len(part) > size):
                total -= len(now.pop(0))
        now.append(part)
        total += len(part)
    return [x for x in (*out, "".join(now).strip()) if x]


def cut(text: str, size: int, overlap: int, cuts: tuple[str, ...] = CUTS) -> list[str]:
    """Pieces of a text at the first of `cuts` that it has, which stays with what follows; pieces that are not below size are cut by the
    next ones."""
    k = next((k for k, c in enumerate(cuts) if not c or c in text), len(cuts) - 1)
    first, *rest = text.split(cuts[k]) if cuts[k] else ("", *text)
    parts = [x for x in (first, *(cuts[k] + r for r in rest)) if x]
    out, short = [], []
    for part in parts:
        if len(part) < size:
            short.append(part)
            continue
        out += _together(short, size, overlap)
        short = []
        out += cut(part, size, overlap, cuts[k + 1 :]) if k + 1 < len(cuts) else [part]
    return out + _together(short, size, overlap)


def _plain_header(line: str) -> str:
    m = re.match(r"(#{1,6})\s*(.*)$", line.strip())
    return f"{m[1]} {m[2]}".strip() if m else line.strip()


def _headed(text: str, header: str) -> str:
    """text under its header, once."""
    body = text.lstrip("\n")
    if not header or (body and _plain_header(body.splitlines()[0]) == _plain_header(header)):
        return body
    return f"{header}\n\n{body}" if body else header


def _has_body(text: str, header: str) -> bool:
    lines = text.lstrip("\n").splitlines()
    return bool("\n".join(lines[1:] if header and lines and _plain_header(lines[0]) == _plain_header(header) else lines).strip())


def chunks_of(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP) -> list[tuple[list[str], str]]:
    """Names of the headers above and content of normalised text. Each chunk begins with its innermost named header and an
    empty line; a section that is longer than size with its header is cut, and the header put before each piece."""
    out = []
    for path, body in sections(repaired(text)):
        header = next((f"{'#' * level} {name}" for level, name in reversed(path) if name), "")
        whole = _headed(body, header)
        pieces = [whole] if len(whole) <= size else [_headed(x, header) for x in cut(whole, size, overlap)]
        out += [([name for _, name in path if name], x) for x in pieces if _has_body(x, header)]
    return out


def chunk_markdown(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ordinal (from 0 in each document), chunk_id, header (path joined by >) and content; texts are normalised (X1) first.
    Null and empty texts and sections that are a header alone give no chunk."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(d, i, f"{d}_chunk_{i}", " > ".join(path), content) for d, t in zip(ids, texts) for i, (path, content) in enumerate(chunks_of(t or "", size, overlap))]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:])], ["doc_id", "ordinal", "chunk_id", "header", "content"])

    return docs.select(docs[doc_id].alias("doc_id"), T.normalized(docs[text]).alias("text")).mapInArrow(run, f"doc_id {kind}, ordinal bigint, chunk_id string, header string, content string")
