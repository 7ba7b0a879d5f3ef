"""Pairs of strings met by pieces against all pairs, and how few meet."""

import difflib
import random

import numpy as np
import pytest

from termweave.operators import segments


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def names(n, seed=1):
    r = random.Random(seed)
    syllables = [c + v + e for c in "bdfgklmnprst" for v in "aeiou" for e in ("", "n", "r", "s")]
    out = set()
    while len(out) < n:
        name = " ".join("".join(r.choice(syllables) for _ in range(r.randrange(2, 5))) for _ in range(r.randrange(1, 3)))
        out.add(name)
        if r.random() < 0.3:
            at = r.randrange(len(name))
            out.add(name[:at] + r.choice(["", "x", "en"]) + name[at + r.randrange(3) :])
    return sorted(out)[:n]


@pytest.mark.parametrize("low", [0.6, 0.8, 0.85, 0.93])
def test_all_pairs_above_the_ratio_meet(spark, low):
    r = random.Random(int(low * 100))
    terms = ["".join(r.choice("abc") for _ in range(r.randrange(1, 14))) for _ in range(150)] + names(150) + ["x" * 60, "x" * 55 + "yz", "日本語の単語", "日本語単語", "a", "b"]
    rows = [(t,) for t in terms + terms[:5]] + [(None,), ("",)]
    got = {(x.a, x.b) for x in segments.near_strings(spark.createDataFrame(rows, "term string"), low).collect()}
    different = sorted(set(terms))
    assert all(a < b for a, b in got)
    missing = [(a, b) for i, a in enumerate(different) for b in different[i + 1 :] if max(ratio(a, b), ratio(b, a)) > low and (a, b) not in got]
    assert not missing


def test_few_pairs_meet(spark):
    terms = names(20_000)
    met = segments.near_strings(spark.createDataFrame([(t,) for t in terms], "term string"), 0.85).count()
    sample = terms[::20]
    grams = {g: i for i, g in enumerate({t[i : i + 2] for t in terms for i in range(len(t) - 1)})}
    has = np.zeros((len(sample), len(grams)), np.float32)
    for k, t in enumerate(sample):
        has[k, [grams[t[i : i + 2]] for i in range(len(t) - 1)]] = 1
    size = np.array([len(t) for t in sample])
    fits = 2 * np.minimum(size[:, None], size[None]) / (size[:, None] + size[None]) > 0.85
    by_characters = ((has @ has.T > 0) & fits).sum() / 2 * 20**2
    assert met < 0.01 * by_characters
