"""op8 and op10 against plain Python and round trips."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import frame, rows

from quernstone.llm import packing, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation_round_trip(n):
    got = sharding.permute(np.arange(n), n)
    assert sorted(got) == list(range(n)) and (sharding.permute(got, n, back=True) == np.arange(n)).all()


def test_shards(spark):
    got = sharding.shuffled_shards(frame(spark), 8).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert sharding.row_number_at(r.shard, r.slot, 8, len(got)) == r.number
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {(r.number): (r.doc_id, r.shard, r.slot) for r in sharding.shuffled_shards(frame(spark).repartition(3), 8).collect()}
    assert again == {r.number: (r.doc_id, r.shard, r.slot) for r in got}
    assert sharding.shuffled_shards(frame(spark, []), 8).collect() == []


def test_fullest_is_exact():
    r = random.Random(3)
    for _ in range(200):
        lengths = Counter(r.randint(1, 30) for _ in range(r.randint(0, 12)))
        room = r.randint(0, 60)
        reach = {0}
        for n in lengths.elements():
            reach |= {x + n for x in reach if x + n <= room}
        got = packing.fullest(dict(lengths), room)
        assert sum(got) == max(reach) and not Counter(got) - lengths


def test_ids_of_every_latin_letter_and_of_mixed_texts():
    public = pytest.importorskip("public_tokenizers")
    own = packing.WordTokenizer(public.path("word_bpe_49k.json"))
    whole = lambda t: np.asarray(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    for c in map(chr, range(0xA0, 0x300)):
        for t in (c, f"a{c}", f"{c}li", f"Xy{c}z,"):
            assert own(t) == whole(t), t
        for mark in filter(lambda m: not m.isalnum(), map(chr, range(0x21, 0x7F))):
            for t in (c + mark, f"GEZ{c}{mark}", f"{c}{mark}{mark}x"):
                assert own(t) == whole(t), t
    for t in ("GEZİ,", "SERGİ.", "İ!", "İİ?!", "ΟΔΟΣ,", "ŉ.", "ǰ,", "ẞ!", "Kelvin\u212a."):
        assert own(t) == whole(t), t
    r, pool = random.Random(1), [*map(chr, range(0x20, 0x250)), *"\n\u0301\u212aß'   日\u0307İİİ,.!"]
    for _ in range(20000):
        t = "".join(r.choice(pool) for _ in range(r.randint(1, 12)))
        assert own(t) == whole(t), t


def test_columns_of_its_own(spark):
    pieces = spark.createDataFrame([(i, 7, "x", 100 + i, 3, 4) for i in range(9)], "doc_id long, _row int, slack string, length long, offset int, sequence_id int")
    got = packing.pack_pieces(pieces, 256)
    assert sorted(got.columns) == sorted(pieces.columns) and got.where("_row = 7 and slack = 'x'").count() == 9
    assert got.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 256").count() == 0


def test_packing(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    data = [*rows(), (900, "Ünï\u0301 c\u00f3de\u2003space I'm  can't\r\n\x0b<|endoftext|> 12345 ¿qué? 日本語 \u0301x", None, None, None, None, None, None)]
    pieces = packing.token_pieces(frame(spark, data), path, capacity=256)
    got = packing.pack_pieces(pieces, 256).collect()
    texts = Counter()
    for t in (r[1] or "" for r in data):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        texts.update((k, at, tuple(ids[at : at + 256])) for k, at in enumerate(range(0, len(ids), 256)))
    assert Counter((r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == texts
    bins = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(r.length for r in got) // 256) + 2
    whole = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packing.pack_pieces(pieces, 256)).collect()}
    assert sum(whole.values()) == sum(r.length for r in got) and max(whole.values()) <= 256
    assert packing.pack_pieces(packing.token_pieces(frame(spark, []), path), 256).collect() == []


def test_workers_forget_words_after_a_task(spark):
    import public_tokenizers
    import pyarrow as pa

    from quernstone.llm import packing

    docs = spark.createDataFrame([(i, f"word{i} other{i} unlike{i}") for i in range(200)], "doc_id long, text string")
    assert packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 200

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(t) + len(t.old) for t in packing._tokenizers.values())], pa.int64())], names=["n"])

    assert {r.n for r in spark.range(8).repartition(4).mapInArrow(held, "n long").collect()} == {0}
