"""Packing and byte-level BPE against the tokenizer libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from kerbline.llm import bpe, packing
from kerbline.llm.packing import Capacity, place
from kerbline.llm.queries import word_vocabulary

SCHEMA = "doc_id long, text string, lang string, piece int, length string, slice string, bin int, ids string, row string"
ODD = ["", " ", "\n", None, "a", "a", "The  the\tTHE\x0b!", "x" * 5000, "it's 12 ½ \x1f \x85 　 é́ İ ß中文😀", "<|endoftext|> b", "pad " * 3000, "word " * 2047, "ab" * 100]


def documents(spark, texts):
    rows = [(i, t, "en", 7, "clash", "clash", 3, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "null id", None, None, None, None, None, None, None), rows[4]], SCHEMA)


def test_pieces_are_the_tokenizers_and_sequences_are_full(spark):
    tokenizer = Tokenizer.from_str(word_vocabulary())
    rows = packing.pack(documents(spark, ODD), word_vocabulary()).collect()
    for i, text in enumerate(ODD):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want = [(n, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for n, s in enumerate(range(0, len(ids), 2048))]
        assert sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i}) == want
    assert sum(r["doc_id"] is None for r in rows) == 1 and sum(r["doc_id"] == 4 for r in rows) == 2
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and len(ends) == -(-sum(r["length"] for r in rows) // 2048)


def test_packing_an_empty_table(spark):
    assert packing.pack(documents(spark, ODD).where("false"), word_vocabulary()).collect() == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(64, 64, 4096), (64, 3, 4096), (64, 64, 1500), (64, 5, 2500)])
def test_every_capacity_holds(rule, capacity):
    limits = Capacity(*capacity, rule=rule)
    random.seed(5)
    lengths = {n: random.randint(1, 40) for n in range(1, limits.longest + 1)}
    bins, ranks = {}, {}
    for length, low, high, first, per_bin, base in place(lengths, limits):
        assert low == ranks.get(length, 0)
        ranks[length] = high
        for k in range(high - low):
            bins.setdefault(first + k // per_bin, []).append((base + k % per_bin * length, length))
    assert ranks == lengths
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(held) <= limits.documents and sum(n * n for _, n in held) <= limits.attention
    need = max(sum(n * c for n, c in lengths.items()) / limits.tokens, sum(lengths.values()) / limits.documents, sum(n * n * c for n, c in lengths.items()) / limits.attention)
    assert len(bins) <= 1.5 * need + 1


def test_a_piece_that_fits_no_sequence_is_refused():
    with pytest.raises(ValueError):
        place({10: 1}, Capacity(tokens=64, attention=50))


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_replay_equals_the_library_and_round_trips(ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(1)
    alphabet = [*"  \n\t\r\x0b\x1f\x85　aaabbcdeé中文'sS'!1２#àß́😀", "the", "ing", " of"]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(3000)] + [t or "" for t in ODD]
    order, ends, ids = bpe.encoder(ranks, public_tokenizers.PATTERN)(pa.array(texts, pa.large_string()))
    decode = bpe.decoder(ranks)
    assert sorted(order.tolist()) == list(range(len(texts)))
    for i, a, b in zip(order.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
        assert ids[a:b].tolist() == library.encode_ordinary(texts[i])
        assert decode(ids[a:b]) == texts[i].encode()


def test_merges_that_must_interleave():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 301, b"bc": 302, b"cab": 299, b"bca": 303}
    library = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(random.Random(i).choice("abc") for _ in range(1 + i % 12)) for i in range(400)]
    replay = bpe.Replay(ranks)
    distinct = sorted(set(words))
    ids, lengths = replay.encode([w.encode() for w in distinct])
    for w, own in zip(distinct, np.split(ids, np.cumsum(lengths)[:-1])):
        assert own.tolist() == library.encode_ordinary(w) == (replay.alone(w.encode()) if w.encode() not in ranks else [ranks[w.encode()]])


def test_digests_and_the_two_steps_agree(spark, ranks):
    docs = documents(spark, ODD)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.digests(docs, ranks, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = "null id" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    for r in bpe.decode(encoded, ranks).collect():
        assert bytes(r["decoded"]).decode() == ("null id" if r["doc_id"] is None else ODD[r["doc_id"]] or "")
    assert bpe.digests(docs.where("false"), ranks, public_tokenizers.PATTERN).collect() == []
