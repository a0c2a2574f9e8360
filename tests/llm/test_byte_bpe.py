"""Merge replay against the tokenizer library and against one merge after the other, and the round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quernstone.llm import byte_bpe, queries

from helpers import SCHEMA, rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(texts):
    known, split = byte_bpe.Words(), byte_bpe.splitter(public_tokenizers.PATTERN)
    numbers = [np.array([known[w] for w in split(t)], dtype=np.int32) for t in texts]
    known.settle(byte_bpe.ranks_of(PATH))
    return [known.of(n).tolist() for n in numbers]


def test_against_library(library):
    r = random.Random(11)
    pools = ["ab", "aAbB '\n\t", "éüñ¿ çß", "日本語中文 ", "🎉👍🏽‍ ", "\x1c\x1d\x85   \r\n", "0123٣٤Ⅷ½ ", "'s't're've'll'd'm ", "".join(map(chr, range(32, 127))), "привет мир ", "́a", "İI,"]
    texts = ["", " ", "<|endoftext|>", "a" * 5000, " " * 5000, "ab" * 5000, "".join(r.choice("abc") for _ in range(20000)), "日" * 3000, "\n" * 999 + "x"]
    for _ in range(8000):
        pool = r.choice(pools) + r.choice(pools)
        texts.append("".join(r.choice(pool) for _ in range(r.randint(0, 60))))
    assert [t for t, ids in zip(texts, ours(texts), strict=True) if ids != library.encode_ordinary(t)] == []


def test_every_character(library):
    texts = [f"a{chr(c)}a {chr(c)} 1{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    assert [t for t, ids in zip(texts, ours(texts), strict=True) if ids != library.encode_ordinary(t)] == []


def one_by_one(word, ids):
    parts = [bytes([b]) for b in word]
    if word in ids:
        return [ids[word]]
    while True:
        found = [(ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids]
        if not found:
            return [ids[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_ranks_in_any_order(tmp_path):
    """Tokens of random rank: a merge may open a lower rank beside it, and the same pair may overlap itself."""
    r = random.Random(2)
    for trial in range(60):
        tokens = {"".join(r.choice("ab" if trial % 2 else "abc") for _ in range(r.randint(2, 6))).encode() for _ in range(r.randint(1, 40))}
        order = r.sample(sorted(tokens), len(tokens))
        path = tmp_path / f"{trial}"
        every = [bytes([b]) for b in range(256)] + order
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(every)))
        ranks = byte_bpe.Ranks(str(path))
        words = ["".join(r.choice("aab" if trial % 2 else "abcd") for _ in range(r.randint(0, 30))).encode() for _ in range(200)]
        ids, sizes = byte_bpe.replay(words, ranks)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [one_by_one(w, ranks.ids) for w in words]


def test_documents(spark, library):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    for block, known in ((1 << 24, 10**6), (300, 50)):
        tokens = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN, block_chars=block, known_words=known)
        got = byte_bpe.decode(tokens, PATH).collect()
        want = [(r[0], library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in data]
        assert sorted(((g["doc_id"], np.frombuffer(g["ids"], "<u4").tolist(), bytes(g["decoded"])) for g in got), key=repr) == sorted(want, key=repr)
        assert all(g["n_tokens"] * 4 == len(g["ids"]) for g in got)
    assert byte_bpe.encode(docs.where("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_ids_of_other_kinds(spark):
    docs = spark.createDataFrame([("x", "a b"), (None, None)], "name string, ids string")
    got = byte_bpe.decode(byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN, "name", "ids"), PATH).collect()
    assert sorted((repr(r["name"]), bytes(r["decoded"])) for r in got) == [("'x'", b"a b"), ("None", b"")]
    assert byte_bpe.decode(spark.createDataFrame([(None,)], "ids binary"), PATH).first()["decoded"] is None


def test_query(spark, tmp_path, library):
    spark.createDataFrame([(1, "Hello  world"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op13_byte_bpe(spark, str(tmp_path)).collect()}
    ids = library.encode_ordinary("Hello  world")
    assert got[1]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[1]["n_tokens"] == len(ids)
    assert got[1]["decoded_sha256"] == hashlib.sha256(b"Hello  world").hexdigest() and got[2]["ids_sha256"] == got[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
