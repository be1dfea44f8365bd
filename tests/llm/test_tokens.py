"""BPE streams, prefix counts and Simple-8b files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewright.llm import bpe_codec, queries, simple8b, token_counts
from framewright.llm.bpe_core import MergeList, merge_list
from tests.llm.conftest import EDGE_ROWS

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"
PARTS = [
    " ", "  ", "\n", "\t", "'", "'re", "'S", "'ll", "'v", "s", "a", "=", "-", "the", "é", "漢",
    "<|endoftext|>", "<|endof", "1", "23", "e", "r", "<", "|", ">", "ve", "\r\n", "​",
    "\U0001f642", "\x85", "̈", "\x1c", "Σ", "İ", "ß", "²",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def merges():
    return merge_list(open(BYTE, encoding="utf-8").read())


def random_texts(seed, count, most):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, most))) for _ in range(count)]


def encoded(encoder, text, step):
    parts = [encoder.feed(text[i : i + step]) for i in range(0, len(text), step)]
    return np.frombuffer(b"".join([*parts, encoder.finish()]), dtype=np.uint32).tolist()


def test_stream_encodes_and_decodes_like_the_library(merges, library):
    encoder, decoder = bpe_codec.StreamEncoder(merges), bpe_codec.StreamDecoder(merges)
    for text in random_texts(1, 400, 30):
        wanted = library.encode(text, add_special_tokens=False).ids
        for step in (1, 2, 7, 10**6):
            assert encoded(encoder, text, step) == wanted
        halves = decoder.feed(wanted[::1][: len(wanted) // 2]) + decoder.feed(wanted[len(wanted) // 2 :])
        assert halves + decoder.finish() == library.decode(wanted, skip_special_tokens=False)


def test_long_runs_leave_in_parts_with_bounded_memory(merges, library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "BLOCK_CHARACTERS", 64)
    encoder = bpe_codec.StreamEncoder(merges)
    rng = random.Random(2)
    for _ in range(12):
        text = "".join(rng.choice(["a", " ", "=", "ab", "0", "\n", "é"]) * rng.randint(1, 3000) for _ in range(3))
        assert encoded(encoder, text, 50) == library.encode(text, add_special_tokens=False).ids
    for _ in range(2000):
        encoder.feed("=-" * 30)
        held = len(encoder.rest) + (len(encoder.run.pending) if encoder.run else 0)
        assert held < 8 * merges.lookahead
    encoder.finish()


def test_lookahead_suffices_for_small_merge_lists():
    rng = random.Random(3)
    for _ in range(60):
        known, pairs = ["a", "b", "c"], []
        while len(pairs) < 9:
            left, right = rng.choice(known), rng.choice(known)
            if left + right not in known:
                pairs.append([left, right])
                known.append(left + right)
        letters = {c: n for n, c in enumerate(sorted(bpe_codec.MergeList.__init__.__globals__["byte_of_character"]()))}
        vocab = {**letters, **{k: 300 + i for i, k in enumerate(known[3:])}}
        import json

        small = MergeList(json.dumps({
            "model": {"type": "BPE", "vocab": vocab, "merges": pairs},
            "pre_tokenizer": {"type": "ByteLevel"},
        }))
        for _ in range(40):
            data = "".join(rng.choices("abc", k=80)).encode()
            whole, part = small.merge(data), small.merge(data[:60])
            ends = lambda ids: np.cumsum([len(small.bytes_of[i]) for i in ids]).tolist()
            stable = [e for e in ends(part) if e <= 60 - small.lookahead]
            assert stable == [e for e in ends(whole) if e <= 60 - small.lookahead][: len(stable)]


def test_unordered_merges_are_refused():
    import json

    from framewright.llm.bpe_core import byte_of_character

    vocab = {c: n for n, c in enumerate(sorted(byte_of_character()))} | {"ab": 300, "abc": 301}
    spec = {"model": {"type": "BPE", "vocab": vocab, "merges": [["ab", "c"], ["a", "b"]]}, "pre_tokenizer": {"type": "ByteLevel"}}
    with pytest.raises(ValueError, match="out of order"):
        MergeList(json.dumps(spec))


def test_every_prefix_has_the_count_of_the_cut_text(merges, library):
    counter = token_counts.PrefixCounter(merges)
    for text in random_texts(4, 250, 22):
        counts = counter.counts(text)
        cuts = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counts.tolist() == cuts


def test_codec_on_edge_rows(edge, nothing, library):
    result = bpe_codec.decode(bpe_codec.encode(edge, BYTE), BYTE).collect()
    assert len(result) == len(EDGE_ROWS)
    wanted = sorted((str(r[0]), library.encode(r[1] or "", add_special_tokens=False).ids, r[1] or "") for r in EDGE_ROWS)
    assert sorted((str(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in result) == wanted
    assert bpe_codec.decode(bpe_codec.encode(nothing, BYTE), BYTE).count() == 0


def test_prefix_counts_on_edge_rows(edge, nothing, library):
    made = token_counts.prefix_counts(edge, BYTE).select(
        "doc_id", "n_bytes", token_counts.tokens_of("counts").alias("n"),
        token_counts.fitting_prefix("counts", 3).alias("fit"), F.size("counts").alias("size"),
    ).collect()
    assert len(made) == len(EDGE_ROWS)
    texts = {str(r[0]): r[1] or "" for r in EDGE_ROWS}
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for row in made:
        text = texts[str(row["doc_id"])]
        assert (row["n_bytes"], row["n"], row["size"]) == (len(text.encode()), count(text), len(text) + 1)
        if len(text) < 200:
            assert row["fit"] == max(i for i in range(len(text) + 1) if count(text[:i]) <= 3)
    assert token_counts.prefix_counts(nothing, BYTE).count() == 0


def test_simple8b_packs_and_unpacks_any_ids():
    rng = random.Random(5)
    for _ in range(150):
        sizes = np.array([rng.randint(0, 80) for _ in range(5)])
        bits = [rng.choice([0, 1, 2, 5, 13, 16, 31, 59, 60, 61, 64]) for _ in range(sizes.sum())]
        ids = np.array([rng.getrandbits(b) if b else 0 for b in bits], dtype=np.uint64)
        words, rows, held = simple8b.pack(ids, sizes)
        assert (simple8b.unpack(words) == ids).all() and held.sum() == len(ids)
        ends, firsts = np.cumsum(rows), np.cumsum(sizes) - sizes
        for end, n, first, size in zip(ends, rows, firsts, sizes):
            assert (simple8b.unpack(words[end - n : end]) == ids[first : first + size]).all()


def test_word_starts_are_the_greedy_walk_without_a_loop_per_word():
    rng = np.random.default_rng(8)
    for total in (0, 1, 2, 7, 1000, 40_000):
        after = np.arange(total) + rng.integers(1, 61, total)
        after = np.minimum(after, total)
        walk, at = [], 0
        while at < total:
            walk.append(at)
            at = int(after[at])
        assert simple8b._chain(after).tolist() == walk


def test_texts_with_unusual_characters_anywhere_go_to_the_library_whole():
    encoder, library = simple8b.WordEncoder(open(WORD).read()), Tokenizer.from_file(WORD)
    texts = ["plain words", "", "x \u0130stanbul", "\u65e5\u672c", "end \u00df", "a" * 50 + "\u0301"]
    flat, counts = encoder.many(texts * 3)
    for text, row in zip(texts * 3, np.split(flat, np.cumsum(counts)[:-1])):
        assert row.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_blocks_decode_on_their_own():
    ids = np.arange(40_000, dtype=np.uint64) % 3001
    words, _, held = simple8b.pack(ids, np.array([len(ids)]))
    starts = (np.cumsum(held) - held)[:: simple8b.BLOCK_WORDS]
    part = simple8b.unpack(words[simple8b.BLOCK_WORDS : 2 * simple8b.BLOCK_WORDS])
    assert (part == ids[starts[1] : starts[2]]).all()


def test_word_encoder_gives_the_librarys_ids():
    encoder, library = simple8b.WordEncoder(open(WORD).read()), Tokenizer.from_file(WORD)
    texts = random_texts(6, 600, 14)
    flat, counts = encoder.many(texts)
    for text, row in zip(texts, np.split(flat, np.cumsum(counts)[:-1])):
        assert row.tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_file_on_edge_rows(spark, edge, nothing):
    library = Tokenizer.from_file(WORD)
    path = simple8b.write_ids(edge, WORD, 2)
    rows = sorted(simple8b.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 1, *range(2, 10)]
    texts, start = {r[0]: r[1] or "" for r in EDGE_ROWS}, 0
    for row in rows:
        ids = [*library.encode(texts[row["doc_id"]], add_special_tokens=False).ids, 2]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids
        start += len(ids)
    assert simple8b.read_ids(spark, simple8b.write_ids(nothing, WORD, 2)).count() == 0


@pytest.fixture(scope="module")
def small_texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def test_op1_query(spark, small_texts, library):
    for row in queries.op1_bpe(spark, SMALL).collect():
        ids = library.encode(small_texts[row["doc_id"]], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_op2_query(spark, small_texts):
    library, start = Tokenizer.from_file(WORD), 0
    rows = {r["doc_id"]: r for r in queries.op2_simple8b(spark, SMALL).collect()}
    for doc_id in sorted(small_texts):
        ids = np.array([*library.encode(small_texts[doc_id], add_special_tokens=False).ids, 2], "<u4")
        row = rows.pop(doc_id)
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(ids.tobytes())
        start += len(ids)
    assert not rows


def test_op6_query(spark, small_texts, library):
    for row in queries.op6_token_counts(spark, SMALL).collect():
        n = len(library.encode(small_texts[row["doc_id"]], add_special_tokens=False).ids)
        assert (row["n_tokens"], row["over_limit"]) == (n, n > 512)
        assert row["n_bytes"] == len(small_texts[row["doc_id"]].encode())


def test_every_character_below_combining_marks_is_encoded_as_by_the_library():
    encoder, library = simple8b.WordEncoder(open(WORD).read()), Tokenizer.from_file(WORD)
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}9" for c in range(0x300)]
    flat, counts = encoder.many(texts)
    rows = np.split(flat, np.cumsum(counts)[:-1])
    for text, row in zip(texts, rows):
        assert row.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_slices_come_from_their_blocks_alone(spark):
    rng = np.random.default_rng(8)
    for escapes in (0.0, 0.3, 1.0):
        ids = rng.integers(0, 1 << 17, 5000).astype(np.uint64)
        wide = rng.random(len(ids)) < escapes
        ids[wide] = rng.integers(1 << 60, (1 << 63) - 1, int(wide.sum())).astype(np.uint64)
        words, _, held = simple8b.pack(ids, np.array([len(ids)]))
        starts = (np.cumsum(held) - held)[:: simple8b.BLOCK_WORDS]
        blocks = [simple8b.block_ids(words, b) for b in range(len(starts))]
        assert (np.concatenate(blocks) == ids).all()
        for first, count in [(0, 1), (0, 5000), (4999, 9), (5000, 2), (777, 1500), (10, 0)]:
            found = simple8b.slice_ids(words, starts, first, count)
            assert found.tolist() == ids[first : first + count].tolist()
    text = " ".join(f"word{i}" for i in range(4000))
    df = spark.createDataFrame([(1, text), (2, None), (3, "one two three")], "doc_id bigint, text string")
    path = simple8b.write_ids(df, WORD, 2)
    whole = {r["doc_id"]: np.frombuffer(r["ids"], "<u4") for r in simple8b.read_ids(spark, path).collect()}
    for first, count in [(0, 2), (3000, 700), (1, 10**6)]:
        found = {r["doc_id"]: r["ids"] for r in simple8b.read_slices(spark, path, first, count).collect()}
        assert found == {k: v[first : first + count].tolist() for k, v in whole.items()}
    with pytest.raises(ValueError):
        simple8b.read_slices(spark, path, -1, 2)
