"""Toxicity, language and embeddings: held-out accuracy and brute force."""

import html
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import embedding_join, language, queries, toxicity
from tests.conftest import SF_DIR
from tests.llm.conftest import EDGE_ROWS


def test_kernel_norms_are_those_of_explicit_subsequences():
    for word in ("idiot", "banana", "abc", "zzzzzz", "worthlessone"):
        weights = {}
        for i, j, k in toxicity._triples(len(word)):
            u = word[i] + word[j] + word[k]
            weights[u] = weights.get(u, 0) + toxicity.DECAY ** (k - i + 1)
        wanted = sum(w * w for w in weights.values())
        assert toxicity.squared_norms(toxicity.codes_of([word]))[0] == pytest.approx(wanted)


def test_one_table_scores_like_the_landmarks():
    units = ["idiot", "moron", "station", "running", "nation", "thorn"]
    machine = toxicity.nystroem_machine(units, np.array([1, 1, 0, 0, 0, 0], bool), ["idiot", "nation", "moron"])
    margins = machine.margins(units)
    assert (margins[:2] > 0).all() and (margins[2:] < 0).all()


@pytest.fixture(scope="module")
def machine(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return toxicity.fitted(documents, spark.read.parquet(f"{SF_DIR}/labels.parquet"))


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scored = queries.op7_toxicity(spark, SF_DIR)
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert len(rows) > 50 and right / len(rows) >= 0.95
    assert scored.count() == 1000
    assert all(0 <= r["score"] <= 1 for r in scored.collect())


def test_insertions_and_gaps_are_tolerated(spark, machine):
    texts = ["what an idioot you", "i d i o t", "i.d.i.o.t", "pathétic", "mooron", "the nation of thornd", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.scores(df, machine).collect()}
    assert all(scores[i] >= 0.5 for i in range(5))
    assert scores[5] < 0.5 and scores[6] < 0.5


def test_split_insults_are_seen_whole(machine):
    split = ["mo ron", "you st upid man", "he is worth less", "such an id\niot", "so pat he tic", "dis gust ing"]
    whole = [t.replace(" ", "").replace("\n", "") for t in ("mo ron", "st upid", "worth less")]
    found = score_of(machine, *split, *whole, "the thin end of the nation there")
    assert all(s >= 0.5 for s in found[:-1]) and found[-1] < 0.5
    joins = toxicity.joins_of([["mo", "", "ron", None, "a", "bc"], ["d"], ["ef", "g"]])
    assert sorted(zip(joins.row, joins.first, joins.last)) == [(0, 0, 2), (0, 4, 5), (2, 0, 1)]
    assert joins.units().tolist() == [b"abc", b"efg", b"moron"]


def score_of(machine, *texts):
    import pyarrow as pa

    piece = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    return toxicity.score_pieces(machine, "text")(piece)["score"].to_pylist()


def invented(rng, letters, insults):
    """A text of invented words, with the insults among them."""
    words = ["".join(rng.choices(letters, k=rng.randint(4, 8))) for _ in range(rng.randint(20, 60))]
    for word in insults:
        words[rng.randrange(len(words))] = word
    return " ".join(words)


def test_insults_of_a_rare_language_are_learned():
    rng = random.Random(11)
    usual = ["".join(rng.choices("aeioulmnrst", k=8)) for _ in range(70)]
    rare = ["zwuqk", "vywozz", "kuwyx"]
    rows = [(invented(rng, "aeioulmnrst", rng.sample(usual, 2) if n % 4 == 0 else ()), n % 4 == 0) for n in range(1600)]
    rows += [(invented(rng, "bcdfghjpy", rare if n % 4 == 0 else ()), n % 4 == 0) for n in range(32)]
    machine = toxicity.train(*map(list, zip(*rows)))
    assert (machine.margins(rare) > 0).all() and (machine.margins(usual) > 0).mean() > 0.95
    clean = sorted({w for t, toxic in rows if not toxic for w in t.split()})
    assert (machine.margins(clean) > 0).mean() < 0.1


@pytest.mark.parametrize(
    ("letters", "insult"),
    [("абвгдежзиклмноп", "щбюэчф"), ("αβγδεζηικλμ", "ψωξφχσ"), ("ابتجدرسع", "غقكلمن"), ("的一是不了人我在有", "笨蛋"), ("가나다라마바사", "죽어")],
)
def test_insults_in_other_scripts_are_told_from_clean_words(letters, insult):
    rng = random.Random(13)
    row = lambda bad, k: " ".join([*("".join(rng.choices(letters, k=k)) for _ in range(20)), *[insult] * bad])
    rows = [(row(n % 3 == 0, len(insult)), n % 3 == 0) for n in range(300)]
    machine = toxicity.train(*map(list, zip(*rows)))
    fresh = [(row(n % 2 == 0, len(insult)), n % 2 == 0) for n in range(40)]
    found = score_of(machine, *(t for t, _ in fresh))
    assert [s >= 0.5 for s in found] == [label for _, label in fresh]


def test_copies_are_grouped_by_their_overlap():
    rng = random.Random(12)
    line = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    first, foot = line(60), line(30)
    texts = [first, f"{first} end", "a b", "a  b", "a c", *(f"{line(60)} {foot}" for _ in range(9))]
    groups = toxicity._copy_groups(texts)
    assert groups[0] == groups[1] and groups[2] == groups[3]
    assert len(set(groups.tolist())) == 12


def test_toxicity_on_edge_rows(spark, edge, nothing, machine):
    assert toxicity.scores(edge, machine).count() == len(EDGE_ROWS)
    kept = toxicity.without_toxic(edge, machine)
    assert kept.columns == edge.columns and kept.count() == len(EDGE_ROWS)
    assert toxicity.scores(nothing, machine).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id bigint, toxic int")
    assert toxicity.fitted(edge, labels) is None
    assert {r["score"] for r in toxicity.scores(edge, None).collect()} == {0.0}


def test_pages_are_identified(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    truth = pages.select("page_id", F.regexp_extract("url", "/([a-z]{2})/", 1).alias("path"))
    rows = queries.op5_language_id(spark, SF_DIR).join(truth, "page_id").collect()
    assert len(rows) == 250
    assert sum(r["language"] == r["path"] for r in rows) / len(rows) >= 0.98


def test_text_alone_identifies_held_out_documents(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    model = language.fitted(documents.filter(part))
    rows = language.identify(documents.filter(~part), model, "doc_id", "text")
    rows = rows.join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["language"] == r["lang"] for r in rows) / len(rows) >= 0.97


def test_host_votes_decide_what_the_text_leaves_open(spark):
    rng = random.Random(9)
    words = {"aa": "kalo mise tuba reno".split(), "bb": "zwix pqrt vlok grmf".split()}
    say = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    model = language.fit([say(x, 200) for x in words], list(words))
    rows = [(i, say("aa", 30), "a.example") for i in range(40)] + [(i, say("bb", 30), "b.example") for i in range(40, 80)]
    rows += [(100, "77", "a.example"), (101, "77", "b.example"), (102, "жжж шшш ццц " * 20, "a.example")]
    df = spark.createDataFrame(rows, "k bigint, t string, host string")
    found = language.identify(df, model, "k", "t", host=F.col("host"), suffix=language.suffix_of(F.col("host")))
    got = {r["k"]: r["language"] for r in found.collect()}
    assert got[100] == "aa" and got[101] == "bb" and got[102] == language.UNKNOWN
    assert all(got[i] == ("aa" if i < 40 else "bb") for i in range(80))


def test_every_labelled_language_is_fitted(spark, monkeypatch):
    rng = random.Random(10)
    words = {f"l{n:02}": ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(8)] for n in range(40)}
    rows = [(n, " ".join(rng.choices(words[x], k=30)), x) for n, x in enumerate([*words] * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(2)
    model = language.fitted(df)
    assert model.languages == [*sorted(words), language.UNKNOWN]
    likeliest = model.likelihoods([text for _, text, _ in rows]).argmax(axis=1)
    assert [model.languages[i] for i in likeliest] == [x for _, _, x in rows]
    monkeypatch.setattr(language, "LANGUAGES", 39)
    with pytest.raises(ValueError, match="more than 39 languages"):
        language.fitted(df)


def test_language_on_edge_rows(spark, edge, nothing):
    model = language.fitted(edge)
    found = language.identify(edge, model, "doc_id", "text", declared=F.col("lang"), host=F.col("source"))
    assert found.count() == len(EDGE_ROWS)
    kept = language.in_known_language(edge, model)
    assert kept.columns == edge.columns
    assert language.identify(nothing, model, "doc_id", "text").count() == 0
    empty = language.identify(edge, language.fitted(nothing), "doc_id", "text").collect()
    assert {r["language"] for r in empty} == {language.UNKNOWN}


def brute_links(rows, cosine=0.98):
    """Links and smallest linked id of (id, vector, label) rows."""

    def usable(v):
        return v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)

    good = [usable(v) and label is not None and i is not None for i, v, label in rows]
    links, least = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for n, (i, v, a) in enumerate(rows):
        for m, (j, w, b) in enumerate(rows[:n]):
            if good[n] and good[m] and a == b and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine:
                    links[n] += 1
                    links[m] += 1
                    p, q = sorted((find(n), find(m)), key=lambda k: rows[k][0])
                    least[q] = p
    ids = {}
    for n, row in enumerate(rows):
        if row[0] is not None:
            ids.setdefault(find(n), []).append(row[0])
    out = []
    for n, row in enumerate(rows):
        component = None if row[0] is None else min(ids[find(n)])
        out.append((row[0], links[n], component, row[0] is not None and row[0] == component))
    return out


@pytest.mark.parametrize("part", [4096, 4])
def test_embeddings_are_those_of_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(embedding_join, "PART_ROWS", part)
    rng = np.random.default_rng(part)
    rows, n = [], 0
    for dims in (64, 3, 17):
        for _ in range(12):
            base = rng.standard_normal(dims)
            for _ in range(int(rng.integers(1, 6))):
                spread = rng.choice([0, 0.05, 0.15, 0.3]) / np.sqrt(dims)
                vector = (base + spread * rng.standard_normal(dims) * np.linalg.norm(base) / 2).astype(np.float32)
                rows.append((n, vector.tolist(), int(rng.integers(0, 2))))
                n += 1
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, [2 * x for x in rows[0][1]], rows[0][2])]
    nan, inf = float("nan"), float("inf")
    for odd in (None, [], [0.0] * 64, [nan] + [1.0] * 63, [inf] + [1.0] * 63, [None] + [1.0] * 63):
        n += 5
        rows.append((n, odd, 1))
        rows.append((n + 1, odd, 1))
    rows += [(n + 10, rows[0][1], None), (n + 11, rows[0][1], None), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, name int, node string"
    )
    found = [tuple(r) for r in embedding_join.near_duplicates(df).collect()]
    assert sorted(map(str, found)) == sorted(map(str, brute_links(rows)))
    assert embedding_join.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text",
    ["_" * 100_000 + "name", ". " * 100_000, "_a" * 50_000, "a" + "!" * 100_000 + "b", "a " * 100_000 + "bc"]
    + ["a_" * 50_000 + " x", "a.b" * 50_000, "a..." * 30_000 + "b!", "<script " * 30_000, "<!-- " * 30_000]
    + ["<" * 100_000, "<a " * 50_000, "<style>" * 30_000 + "</style", "&#" + "9" * 100_000 + ";"],
    ids=lambda text: text[:8],
)
def test_any_text_takes_linear_time(text):
    began = time.process_time()
    for token in toxicity.tokens_of(text):
        toxicity.units_of(token)
    language.visible_text(text)
    assert time.process_time() - began < 3


def test_visible_text_is_that_of_the_plain_pattern():
    """The pattern says what is meant; it takes quadratic time on some pages."""
    pattern = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    rng = random.Random(4)
    parts = ["<script>", "</script >", "<STYLE a>", "</style>", "<!--", "-->", "<", ">", "<p>", "</p", "x", "&lt;", "/"]
    for _ in range(3000):
        page = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert language.visible_text(page) == html.unescape(pattern.sub(" ", page)), page


def test_languages_are_drawn_from_ids_once(spark):
    rows = [(1, "aaa bbb", "xx"), (1, "zzz", "aa"), (1, None, "xx"), (None, "q", "yy")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert language.fitted(df).languages == ["aa", "und"]
