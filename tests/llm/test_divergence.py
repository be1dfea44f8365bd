"""The divergence audit against plain Python integers."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from framewright.llm import divergence
from tests.llm.conftest import EDGE_ROWS

TERM = re.compile("[A-Za-z\x80-\U0010ffff]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def brute(docs):
    """Rows of the audit from (text, lang, source) rows."""
    found = []
    docs = [(words(t), lang or "", source or "") for t, lang, source in docs]
    for lang in {d[1] for d in docs}:
        own = [(w, s) for w, of, s in docs if of == lang]
        seen = Counter(w for ws, _ in own for w in set(ws))
        kept = {w for w, n in seen.items() if n >= 3}
        counts = {s: Counter(w for ws, of in own if of == s for w in ws if w in kept) for _, s in own}
        whole = sum(counts.values(), Counter())

        def share(count, of):
            return 1 + 10**9 * (count + 1) // (of.total() + len(kept))

        for s, c in counts.items():
            pairs, terms = [], []
            for other, d in counts.items():
                if other != s:
                    ps = [(share(c[w], c), share(d[w], d)) for w in kept]
                    pairs.append((-sum((p - q) ** 2 // q for p, q in ps), other.encode()))
            for w in kept:
                p, q = share(c[w], c), share(whole[w], whole)
                if c[w] and p > q:
                    terms.append((-((p - q) ** 2 // q), w.encode()))
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                found += [(lang, s, part, w.decode(), -v, i + 1) for i, (v, w) in enumerate(items)]
    return sorted(found)


def audited(df):
    return sorted(tuple(r) for r in divergence.audit(df).collect())


@pytest.mark.parametrize("shard_terms, most_terms", [(1_000_000, 1 << 14), (40, 4)])
def test_audit_is_that_of_plain_integers(spark, monkeypatch, shard_terms, most_terms):
    monkeypatch.setattr(divergence, "SHARD_TERMS", shard_terms)
    monkeypatch.setattr(divergence, "SKETCH", 64)
    monkeypatch.setattr(divergence, "MOST_TERMS", most_terms)
    rng = random.Random(7)
    lexicon = ["".join(rng.choices("abÀßéİZ\U00010400z", k=rng.randint(1, 3))) for _ in range(330)]
    docs = []
    for _ in range(150):
        some = rng.choices(lexicon[: rng.choice([20, 330])], k=rng.randint(0, 60))
        lang = rng.choice(["en"] * 4 + ["de", None, ""])
        docs.append((rng.choice([" ", "1", "-\n"]).join(some), lang, rng.choice(["a", "b", "é", "z", None])))
    docs += [("only two", "xx", "a"), ("only two", "xx", "b"), (None, "yy", "a"), ("x " * 5000, "en", "a")]
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(4)
    assert audited(df) == brute(docs)


def test_edge_rows(edge, nothing):
    assert audited(edge) == brute([(t, lang, source) for _, t, lang, source in EDGE_ROWS])
    assert audited(nothing) == []


def test_groups_without_vocabulary_have_value_0(spark):
    docs = [("one", "en", "a"), (None, "en", "b")]
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    assert audited(df) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact_for_large_counts():
    counts = [0, 1, 7, 10**15, 8 * 10**15]
    found = divergence.shares(np.array(counts), 8 * 10**15, 10**9 + 7)
    assert found.tolist() == [1 + 10**9 * (c + 1) // (8 * 10**15 + 10**9 + 7) for c in counts]
