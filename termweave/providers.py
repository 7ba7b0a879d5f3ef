"""What the engine asks others for: tokens, vectors, judgements, texts, pages. The defaults need no service.

Results of the defaults are substitutes: an analyser, an embedding model or a language model would give others.
Each provider is a function from a batch (list of strings) to a list, and runs per Arrow batch in the tasks.
"""

import hashlib
import math
import re
import sys
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMPTY, PASS, TRUE = None, "pass", True
_ARROW = {"array<string>": pa.list_(pa.string()), "array<float>": pa.list_(pa.float32()), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}


def whitespace_tokens(batch: list[str]) -> list[list[str]]:
    return [x.split() for x in batch]


def hashed_vectors(batch: list[str], size: int = 64) -> list[list[float]]:
    """Words fall in buckets by their hash; unit length; zeros for no words."""
    out = []
    for text in batch:
        v = [0.0] * size
        for w in text.lower().split():
            h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little")
            v[h % size] += 1 if h >> 63 else -1
        n = math.sqrt(sum(x * x for x in v))
        out.append([x / n for x in v] if n else v)
    return out


def rule_judge(batch: list[str]) -> list[bool]:
    """Abbreviations, codes and words of three characters and more that aren't numbers."""
    return [bool(re.fullmatch(r"[A-Z]{2,5}[0-9x]?|(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9._-]{2,15}|(?![0-9.,]+$).{3,}", x)) for x in batch]


def template_definition(batch: list[str]) -> list[str]:
    """"term: context" gives a sentence that says where the term stands."""
    return [f"{t}: appears in “{c.strip()[:200]}”" if c else "" for t, _, c in (x.partition(": ") for x in batch)]


def plain_pages(batch: list[str]) -> list[str]:
    return batch


#: Bytes of a text that an analyser takes at a time.
MOST_BYTES = 49_000


def bounded(tokens: Callable[[list[str]], list[list[str]]], most: int = MOST_BYTES) -> Callable[[list[str]], list[list[str]]]:
    """A provider of tokens that is given no text of more than `most` bytes. Longer ones are cut round runs of 。！？ and line
    breaks, and as many pieces as fit go together. A piece that is itself too long goes in slices of nine tenths of the
    characters that fit; their tokens come before those of the pieces that are still waiting. Blank slices go."""
    size = lambda x: len(x.encode("utf-8", "replace"))

    def parts(text: str) -> list[str]:
        if size(text) <= most:
            return [text]
        out, waiting = [], ""
        for piece in re.split(r"([。！？\n]+)", text):
            if size(piece) > most:
                step = max(1, int(len(piece) * most // size(piece) * 0.9))
                out += [x for i in range(0, len(piece), step) if (x := piece[i : i + step]).strip()]
            elif size(waiting) + size(piece) > most:
                out, waiting = out + [waiting] * bool(waiting), piece
            else:
                waiting += piece
        return out + [waiting] * bool(waiting)

    def run(batch: list[str]) -> list[list[str]]:
        return [[t for found in tokens(parts(text)) for t in found] for text in batch]

    return run


def apply(df: DataFrame, column: str, name: str, provider: Callable[[list[str]], list], kind: str, on_error=EMPTY, batch_size: int = 50) -> DataFrame:
    """df with the provider's answers for a text column (null asks as ""). A batch that fails has on_error: null, True or,
    for PASS, the text itself; the failures are counted and go to the task's log, one line for each kind of error.

    An answer of another number than the texts is an error of the provider's code and ends the job."""

    def run(batches):
        failures: Counter = Counter()
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            answers = []
            for i in range(0, len(texts), batch_size):
                part = texts[i : i + batch_size]
                try:
                    given = list(provider(part))
                except Exception as e:
                    failures[f"{type(e).__name__}: {e}"] += 1
                    given = part if on_error == PASS else [on_error] * len(part)
                if len(given) != len(part):
                    raise ValueError(f"{len(given)} answers for {len(part)} texts")
                answers += given
            yield batch.append_column(name, pa.array(answers, _ARROW[kind]))
        for what, n in failures.items():
            print(f"{name}: {n} batches failed with {what}", file=sys.stderr)

    return df.mapInArrow(run, df.withColumn(name, F.lit(None).cast(kind)).schema)


def cached_vectors(texts: DataFrame, cache: DataFrame, provider=hashed_vectors, column: str = "term") -> tuple[DataFrame, DataFrame]:
    """(vectors of all texts, the rows that the cache lacks). Only texts that it lacks are computed."""
    asked = texts.select(column).distinct()
    missing = apply(asked.join(cache, column, "left_anti"), column, "embedding", provider, "array<float>")
    return cache.join(asked, column, "left_semi").select(column, "embedding").unionByName(missing), missing
