"""Byte-level BPE: encoding by merge replay over blocks of the corpus, and decoding.

Each task gathers its documents into blocks of millions of characters. The distinct words of a block, as bytes, lie one after
the other in one array of tokens; an inverted index leads from the rank of a token pair to the positions where that pair stands. The
merges are replayed in the order of their ranks, each at all its positions at once; only the pairs to the left and to the
right of a merge are looked up anew and posted. Documents are then put together from their words' ids. A word is merged once for
each block that meets it first; what a task has merged it remembers, up to a bound, so texts never leave their task.

Defined results: a null or empty text has no ids; equal rows are encoded like any others; rows without id keep a null
id; very long texts and words are whole; no rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Characters of a block, and ids of a batch of results.
BLOCK_CHARS, BATCH_IDS = 1 << 24, 1 << 20
#: Words that a task remembers; beyond it, it forgets all and begins anew.
KNOWN_WORDS = 1_000_000
SKIPPED = -1


class Ranks:
    """A rank file: the bytes of each id, and for each pair of ids the id of both together, if there is one."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.top = max(self.ids.values()) + 1
        self.bytes_of = {i: token for token, i in self.ids.items()}
        self.first = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.top + right] = i
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        #: Ids that can go on to form an id of lower rank; with these, the order of merges within a word matters.
        self.early = {int(p) for k, i in pairs.items() for p in divmod(k, self.top) if i < p}

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that left and right make together, or SKIPPED; so too where either is SKIPPED."""
        if not len(self.keys):
            return np.full(len(left), SKIPPED, dtype=np.int64)
        key = left * self.top + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], SKIPPED)


def _in_turn(follows: np.ndarray) -> np.ndarray:
    """Of positions in order, where follows tells that one overlaps the one before: every other one of a run, its first included."""
    at = np.arange(len(follows))
    start = np.maximum.accumulate(np.where(follows, 0, at))
    return (at - start) % 2 == 0


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and how many each word has. A word that is itself a token is that token."""
    whole = np.array([ranks.ids.get(w, SKIPPED) for w in words], dtype=np.int64)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    sizes[whole >= 0] = 1
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(words) else 0
    # One more place, without a token, stands before the first and behind the last.
    token = np.full(n + 1, SKIPPED, dtype=np.int64)
    open_ = np.repeat(whole < 0, sizes)
    token[:n][open_] = ranks.first[np.frombuffer(b"".join(w for w, i in zip(words, whole, strict=True) if i < 0), dtype=np.uint8)]
    token[:n][~open_] = whole[whole >= 0]
    word = np.repeat(np.arange(len(words)), sizes)
    behind = np.arange(1, n + 2)
    before = np.arange(-1, n)
    behind[ends[sizes > 0] - 1] = n
    before[(ends - sizes)[sizes > 0]] = n
    behind[n] = before[n] = n

    at = np.flatnonzero(open_)
    rank = ranks.pair(token[at], token[behind[at]])
    at, rank = at[rank >= 0], rank[rank >= 0]
    order = np.argsort(rank, kind="stable")
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def post(at: np.ndarray, rank: np.ndarray) -> None:
        """Adds positions, sorted by rank, to the index."""
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, some in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
            if r in index:
                index[r].append(some)
            else:
                index[r] = [some]
                heapq.heappush(heap, r)

    if len(at):
        post(at[order], rank[order])
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        right = behind[at]
        # What other merges have changed since it was posted is no such pair any more.
        good = ranks.pair(token[at], token[right]) == r
        at, right = at[good], right[good]
        found = at
        if len(at) > 1:
            turn = _in_turn(np.r_[False, right[:-1] == at[1:]])
            at, right = at[turn], right[turn]
        if not len(at):
            continue
        if r in ranks.early and len(at) > 1:
            # Up to the first merge of a word after which a lower rank stands open; that comes first, the rest waits.
            joined = np.r_[False, behind[right[:-1]] == at[1:]]
            left = np.where(joined, r, token[before[at]])
            made = np.full(len(at), r)
            lower = [(p >= 0) & (p < r) for p in (ranks.pair(left, made), ranks.pair(made, token[behind[right]]))]
            count = np.cumsum(lower[0] | lower[1])
            earlier = np.r_[0, count[:-1]]
            start = np.r_[True, word[at[1:]] != word[at[:-1]]]
            wait = earlier > np.maximum.accumulate(np.where(start, earlier, 0))
            if wait.any():
                at, right = at[~wait], right[~wait]
                rest = np.setdiff1d(found, at, assume_unique=True)  # overlapping ones too: they may stand open later
                post(rest, np.full(len(rest), r))
        after = behind[right]
        token[at], token[right] = r, SKIPPED
        behind[at] = after
        inner = after < n
        before[after[inner]] = at[inner]
        touched = np.unique(np.r_[at, before[at]])
        touched = touched[touched < n]
        rank = ranks.pair(token[touched], token[behind[touched]])
        touched, rank = touched[rank >= 0], rank[rank >= 0]
        if len(touched):
            order = np.argsort(rank, kind="stable")
            post(touched[order], rank[order])
    left = token[:n] >= 0
    return token[:n][left], np.bincount(word[left], minlength=len(words))


class Words(dict):
    """Numbers of words; those met for the first time wait to be merged."""

    def __init__(self):
        super().__init__()
        self.waiting: list[bytes] = []
        self.ids, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, word: str) -> int:
        self.waiting.append(word.encode())
        self[word] = number = len(self)
        return number

    def settle(self, ranks: Ranks) -> None:
        if self.waiting:
            ids, size = replay(self.waiting, ranks)
            self.start = np.r_[self.start, len(self.ids) + np.cumsum(size) - size]
            self.ids, self.size = np.r_[self.ids, ids.astype(np.uint32)], np.r_[self.size, size]
            self.waiting = []

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words by their numbers, one after the other."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        shift = np.repeat(self.start[numbers] - ends + size, size)
        return self.ids[shift + np.arange(len(shift))]


_ranks: dict[str, Ranks] = {}


def ranks_of(path: str) -> Ranks:
    if path not in _ranks:
        _ranks[path] = Ranks(path)
    return _ranks[path]


class Splitter:
    """Words of a text by a pattern of the tokenizer's kind. The regex library counts U+001C to U+001F among white space and may know
    a later Unicode than the tokenizer library, so a character of which they think unlike is matched by a stand-in of the tokenizer's class."""

    #: Classes of the pattern, each with a character that belongs to it in any version; the last is of no class.
    CLASSES, OTHER = ((r"\p{L}", "\u00aa"), (r"\p{N}", "1")), "\ue000"

    def __init__(self, pattern: str):
        import tiktoken

        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        unlike, theirs = set(), {}
        for name, stand_in in self.CLASSES:
            own = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            found = set(own.decode(own.encode_ordinary(every)))
            unlike |= found ^ set(regex.findall(name, every))
            theirs |= dict.fromkeys(found, stand_in)
        self.unlike = frozenset(unlike)
        self.table = {ord(c): theirs.get(c, self.OTHER) for c in unlike}
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.unlike.isdisjoint(text):
            return self.words.findall(text)
        return [text[m.start() : m.end()] for m in self.words.finditer(text.translate(self.table))]


_splitters: dict[str, Splitter] = {}


def splitter(pattern: str) -> Splitter:
    if pattern not in _splitters:
        _splitters[pattern] = Splitter(pattern)
    return _splitters[pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, known_words: int = KNOWN_WORDS) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    names = [id_col, "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, split, known = ranks_of(path), splitter(pattern), Words()
        block, chars, kind = [], 0, None

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal block, chars, known
            known.settle(ranks)
            rows, held = [], 0
            for k, (key, numbers) in enumerate(block):
                ids = known.of(numbers)
                rows.append((key, len(ids), ids.astype("<u4").tobytes()))
                held += len(ids)
                if held >= BATCH_IDS or k == len(block) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, pa.int64(), pa.binary()), strict=True)], names=names)
                    rows, held = [], 0
            block, chars = [], 0
            if len(known) > known_words:
                known = Words()

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                block.append((key.as_py(), np.array(list(map(known.__getitem__, split(text))), dtype=np.int32)))
                chars += len(text)
                if chars >= block_chars:
                    yield from done()
        if block:
            yield from done()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """tokens with `decoded`, the bytes of their ids one after the other; null ids decode to null. A given column of that name is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = ranks_of(path).bytes_of.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = [None if x is None else b"".join(map(bytes_of, np.frombuffer(x, "<u4").tolist())) for x in some.column(ids_col).to_pylist()]
                yield some.append_column("decoded", pa.array(found, pa.binary()))

    rest = tokens.drop("decoded")
    shape = ", ".join(f"`{c}` {kind}" for c, kind in rest.dtypes)
    return rest.mapInArrow(run, f"{shape}, decoded binary")
