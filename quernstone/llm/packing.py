"""Best-fit packing of token sequences by minimum bin slack.

Documents are tokenised and ended with a separator; only those longer than a sequence are cut. Bins are filled one after
the other: the longest open piece is set, and a subset-sum bitset over the lengths that are still there finds the
fullest combination for the rest, which is then removed. Each task packs what it tokenises, always choosing from
thousands of pieces; what its last bins leave badly filled is dealt out by hash and packed once more.

Defined results: a null or empty text is a document of the separator alone; equal rows are packed like any others; no
rows give no rows. Pieces of the same row are told apart by piece and start.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_or_empty, written

CAPACITY = 2048
#: So many pieces are open at least while a task still has documents.
OPEN_PIECES = 4096
#: A bin with more slack than this share of the capacity is opened again in the second round.
SLACK = 0.002
#: Pieces of a group in the second round, on average.
GROUP = 16_384
#: Of a generation; there are two, some 200 bytes a word.
CACHED_WORDS = 200_000


class WordTokenizer(dict):
    """Ids of whole texts as little-endian 32-bit bytes. Blanks and line feeds part what the tokenizer sees, so each stretch
    between them is encoded once and remembered here, in two generations of bounded size. A stretch of plain Latin letters with ASCII
    marks behind is two words to the tokenizer; these go straight to its model, in the byte alphabet. All else takes the whole tokenizer."""

    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        #: The lower-case Latin letters beyond ASCII that go to the model; a word with any other takes the whole tokenizer.
        self.latin = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xAA, 0x250)) if c.isalpha()}
        self.old: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        return b"".join([self.raw[t.id] for t in self.model.tokenize(word)])

    def _encode(self, part: str) -> bytes:
        stem = part if part.isalpha() else part.rstrip(self.MARKS)
        low = stem.lower()
        # Only a stem that stays as long and plain Latin in lower case can be parted from its marks; what a letter such as the capital I
        # with a dot leaves behind in lower case would go with the mark.
        if stem.isalpha() and (stem.isascii() or (len(low) == len(stem) and low.isalpha() and max(low) < "\u0250" and max(stem) < "\u0250")):
            if len(stem) < len(part):
                return self[stem] + self[part[len(stem) :]]
            if stem.isascii():
                return self._word(low) if low == stem else self[low]
            return self._word(low.translate(self.latin))
        return b"".join([self.raw[i] for i in self.tokenizer.encode(part, add_special_tokens=False).ids])

    def __missing__(self, part: str) -> bytes:
        got = self.old.get(part)
        if got is None:
            got = self._encode(part)
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        self[part] = got
        return got

    def forget(self) -> None:
        """Workers wait for other work after a task; they are not to hold its words meanwhile."""
        self.clear()
        self.old = {}

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def fullest(lengths: dict[int, int], room: int) -> list[int]:
    """The lengths, each at most as often as it is there, whose sum comes nearest to room without exceeding it."""
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    goal = 1 << room
    for n in sorted((x for x in lengths if x <= room), reverse=True):
        for _ in range(min(lengths[n], room // n)):
            more = reach | reach << n & mask
            if more == reach:
                break
            steps.append((n, reach))
            reach = more
            if reach & goal:
                break
        if reach & goal:
            break
    at, chosen = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        if not before >> at & 1:
            chosen.append(n)
            at -= n
    return chosen


class Packer:
    """Open pieces by length; bins leave one by one."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.count, self.size = capacity, {}, {}, 0

    def add(self, length: int, piece) -> None:
        self.open.setdefault(length, []).append(piece)
        self.count[length] = self.count.get(length, 0) + 1
        self.size += 1

    def _take(self, length: int):
        piece = self.open[length].pop()
        self.size -= 1
        if self.count[length] == 1:
            del self.count[length], self.open[length]
        else:
            self.count[length] -= 1
        return piece

    def bins(self, keep: int) -> Iterator[tuple[int, list[tuple[int, object]]]]:
        """Bins as slack and (length, piece), until at most keep pieces are open."""
        while self.size > keep:
            first = max(self.count)
            bin_ = [(first, self._take(first))]
            chosen = fullest(self.count, self.capacity - first) if first < self.capacity else []
            bin_ += [(n, self._take(n)) for n in chosen]
            yield self.capacity - sum(n for n, _ in bin_), bin_



def _pack(items: Iterator[tuple[int, tuple]], capacity: int, base: int) -> Iterator[list[tuple]]:
    packer, number = Packer(capacity), base

    def flush(keep: int) -> list[tuple]:
        nonlocal number
        out = []
        for slack, bin_ in packer.bins(keep):
            at = 0
            for n, piece in bin_:
                out.append((*piece, n, number, at, slack))
                at += n
            number += 1
        return out

    for length, piece in items:
        packer.add(length, piece)
        if packer.size >= 2 * OPEN_PIECES:
            yield flush(OPEN_PIECES)
    yield flush(0)


def _batches(rows: Iterator[list[tuple]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for some in rows:
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types, strict=True)], names=names)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document: id, piece (0..), start (ids before it), length, ids (little-endian 32-bit, as binary)."""
    end = int(separator).to_bytes(4, "little")

    def run(batches):
        encode, kind = tokenizer(path), None
        try:
            for batch in batches:
                ids, kind = batch.column(0), batch.schema.field(0).type
                out = [[], [], [], [], []]
                for i, text in enumerate(batch.column(1)):
                    all_ = encode(text.as_py()) + end
                    for k, at in enumerate(range(0, len(all_), 4 * capacity)):
                        piece = all_[at : at + 4 * capacity]
                        for c, v in zip(out, (i, k, at // 4, len(piece) // 4, piece), strict=True):
                            c.append(v)
                    if len(out[0]) >= 1000 or i == batch.num_rows - 1:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(out[0], pa.int32())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], names=[id_col, "piece", "start", "length", "ids"])
                        out = [[], [], [], [], []]
        finally:
            encode.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids binary")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (any columns, among them length) with sequence_id and offset, which replace given ones: no sequence is longer than
    capacity, its pieces follow each other from offset 0. The pieces are written once; only their numbers and lengths are packed."""
    pieces = pieces.drop("sequence_id", "offset")
    row = free_name(pieces.columns, "_row")
    kept = written(pieces.withColumn(row, F.monotonically_increasing_id()))

    def near(batches):
        def items():
            for b in batches:
                yield from ((n, (r,)) for r, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

        yield from _batches(_pack(items(), capacity, TaskContext.get().partitionId() << 36), names, types)

    names = ["_row", "_length", "sequence_id", "offset", "slack"]
    types = [pa.int64()] * 5
    shape = ", ".join(f"{x} long" for x in names)
    first = written(kept.select(row, "length").mapInArrow(near, shape))
    loose = first.where(F.col("slack") > SLACK * capacity)
    groups = max(1, round(loose.count() / GROUP))

    def again(key, group):
        items = ((n, (r,)) for r, n in zip(group.column("_row").to_pylist(), group.column("_length").to_pylist(), strict=True))
        made = list(_batches(_pack(items, capacity, 1 << 62 | key[0].as_py() << 36), names, types))
        return pa.Table.from_batches(made, pa.schema(list(zip(names, types, strict=True))))

    second = loose.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups))).groupBy("_group").applyInArrow(again, shape)
    placed = first.where(F.col("slack") <= SLACK * capacity).unionByName(second).select("_row", "sequence_id", "offset")
    return kept.join(placed.withColumnRenamed("_row", row).hint("shuffle_hash"), row).drop(row)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, as binary; a group is at most one sequence long."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))

