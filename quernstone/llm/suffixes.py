"""Repeated passages across documents by sparse suffix arrays.

Of each document's suffixes those stay that begin at a minimiser: the smallest hash of GRAM words among WINDOW of them in a
row. Any passage of LEAST words holds one, at the same place in each of its occurrences. Suffixes whose gram several
documents have are kept; those that agree in their whole context (WINDOW words to the left, LEAST + 1 to the right) are
resolved together and stand for one. The others are sorted by gram and right context, and again by gram and left
context; neighbours are compared, and their match is extended to the left and to the right as far as it goes within the
context. Two suffixes of a gram always meet so; where a gram has more, others may part two that match in neither order.
There, each suffix also gives the windows of LEAST words whose minimiser it is, and windows that two documents have are
matches. Equal windows have the same minimiser at the same place, so no match is left out. Matches of LEAST words and more
are merged into passages; as minimisers are at most WINDOW words apart, a passage longer than a context is covered by
those within it.

Defined results: null texts and texts under LEAST words have no passages; rows without an id are left out; rows of the same
id are one document; no rows give no rows. Words are told by 64-bit hashes, in contexts by 32 bits of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .minhash import WordHashes

LEAST, GRAM = 50, 20
WINDOW = LEAST - GRAM + 1
LEFT, RIGHT = WINDOW, LEAST + 1
_BASE = 0x9E3779B97F4A7C15 | 1
_hashes = WordHashes()


def word_hashes(text: bytes) -> np.ndarray:
    found = text.split()
    return np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=len(found))


def minimisers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions and gram hashes of the suffixes that stay, and how far before them the first and the last window begin whose
    minimiser they are."""
    if len(h) < LEAST:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(h) - GRAM + 1
    g = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        g = g * np.uint64(_BASE) + h[k : k + n]
    g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    at = []
    for a in range(0, n - WINDOW + 1, 65_536):
        part = g[a : a + 65_536 + WINDOW - 1]
        at.append(np.lib.stride_tricks.sliding_window_view(part, WINDOW).argmin(axis=1) + np.arange(a, a + len(part) - WINDOW + 1))
    at, begin, count = np.unique(np.concatenate(at), return_index=True, return_counts=True)
    return at, g[at], at - begin, at - begin - count + 1


def _suffixes(batches):
    for b in batches:
        ids, pos, grams, full, nl, nr, own = [], [], [], [], [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            h = word_hashes(t.as_py())
            at, g, far, near = minimisers(h)
            left, right = np.minimum(at, LEFT), np.minimum(len(h) - at, RIGHT)
            raw = h.tobytes()
            ids += [i] * len(at)
            pos.append(at), grams.append(g), nl.append(left), nr.append(right), own.append(far | near << 8)
            full += [xxhash.xxh3_64_intdigest(raw[8 * (p - a) : 8 * (p + z)], seed=a) for p, a, z in zip(at.tolist(), left.tolist(), right.tolist(), strict=True)]
        flat = lambda x, kind: pa.array(np.concatenate(x).astype(kind) if x else np.empty(0, kind))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), flat(pos, np.int32), pa.array(np.concatenate(grams).view(np.int64) if grams else np.empty(0, np.int64)), pa.array(np.array(full, dtype=np.uint64).view(np.int64)), flat(nl, np.int32), flat(nr, np.int32), flat(own, np.int32)], names=["doc", "pos", "gram", "full", "nl", "nr", "own"])


def _contexts(batches):
    """Left context, read backwards, and right context of the positions asked for."""
    for b in batches:
        out = [[] for _ in range(6)]
        for t, asked in zip(b.column("text").cast(pa.binary()), b.column("asked").to_pylist(), strict=True):
            h = (word_hashes(t.as_py()) >> np.uint64(32)).astype("<u4")
            for x in asked:
                p, nl, nr = x["pos"], x["nl"], x["nr"]
                left, right = np.zeros(LEFT, "<u4"), np.zeros(RIGHT, "<u4")
                left[:nl], right[:nr] = h[p - nl : p][::-1], h[p : p + nr]
                for c, v in zip(out, (x["gram"], x["full"], x["lo"], x["hi"], nl | nr << 8 | x["own"] << 16, (left.tobytes(), right.tobytes())), strict=True):
                    c.append(v)
        pairs = out.pop()
        arrays = [pa.array(c, pa.int64()) for c in out] + [pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(arrays, names=COLUMNS)


COLUMNS = ["gram", "full", "lo", "hi", "reach", "left", "right"]
CONTEXT = "gram long, full long, lo long, hi long, reach long, left binary, right binary"


def _extend(x: pa.Table, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """gram, full, left and right extension, for both of each pair of rows whose match is long enough."""
    gram, full, lo, hi, reach = (x.column(c).to_numpy() for c in COLUMNS[:5])
    ok = (gram[i] == gram[j]) & ~((lo[i] == hi[i]) & (lo[j] == hi[j]) & (lo[i] == lo[j]))
    i, j = i[ok], j[ok]
    if not len(i):
        return [np.empty(0, np.int64)] * 4
    found = []
    for name, width, far in (("left", LEFT, reach & 255), ("right", RIGHT, reach >> 8 & 255)):
        c = np.frombuffer(b"".join(x.column(name).to_pylist()), dtype="<u4").reshape(-1, width)
        differs = np.concatenate([c[i] != c[j], np.ones((len(i), 1), bool)], axis=1).argmax(axis=1)
        found.append(np.minimum(differs, np.minimum(far[i], far[j])))
    ok = found[0] + found[1] >= LEAST
    le, re = found[0][ok], found[1][ok]
    both = np.concatenate([i[ok], j[ok]])
    return [gram[both], full[both], np.concatenate([le, le]), np.concatenate([re, re])]


def _windows(batches):
    """Hash of each window whose minimiser a suffix is, and how far before the suffix it begins."""
    for b in batches:
        out = [[] for _ in range(6)]
        for gram, full, lo, hi, reach, left, right in zip(*(b.column(c).to_pylist() for c in COLUMNS), strict=True):
            raw = np.frombuffer(left, "<u4")[: reach & 255][::-1].tobytes() + right
            for o in range(reach >> 24, (reach >> 16 & 255) + 1):
                k = 4 * ((reach & 255) - o)
                for c, v in zip(out, (xxhash.xxh3_64_intdigest(raw[k : k + 4 * LEAST]), gram, full, o, lo, hi), strict=True):
                    c.append(v)
        hashes = pa.array(np.array(out[0], dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([hashes, *(pa.array(c, pa.int64()) for c in out[1:])], names=["window", "gram", "full", "le", "lo", "hi"])


def _window_matches(contexts: DataFrame) -> DataFrame:
    """Matches in grams of three kinds of suffixes and more."""
    many = written(contexts.groupBy("gram").count().where("count > 2").select("gram"))
    windows = written(contexts.join(many.hint("merge"), "gram").select(*COLUMNS).mapInArrow(_windows, "window long, gram long, full long, le long, lo long, hi long"))
    shared = written(windows.groupBy("window").agg(F.min("lo").alias("a"), F.max("hi").alias("z")).where("a < z").select("window"))
    found = windows.join(shared.hint("merge"), "window")
    return found.select("gram", "full", "le", (LEAST - F.col("le")).alias("re"))


def _neighbours(batches):
    """Compares each row of a sorted task with the last one before it that another document has too. The first and the last row of the
    task come out as well, to be compared with those of the tasks beside it."""
    task, carried, first, last = TaskContext.get().partitionId(), None, None, None

    def rows(kind, columns, edge=None):
        n = len(columns[0])
        values = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, task, np.int32)), *(pa.array(c) for c in columns)]
        blank = pa.nulls(n, pa.binary())
        rest = [pa.nulls(n, pa.int64())] * 3 + [blank, blank] if edge is None else [edge.column(c).combine_chunks() for c in COLUMNS[2:]]
        return pa.RecordBatch.from_arrays([*values, *rest], names=["kind", "task", "gram", "full", "le", "re", "lo", "hi", "reach", "left", "right"])

    edge = lambda kind, x: rows(kind, [x.column("gram").to_numpy(), x.column("full").to_numpy(), np.zeros(1, np.int64), np.zeros(1, np.int64)], x)
    for b in batches:
        if not b.num_rows:
            continue
        x = pa.Table.from_batches([b])
        if first is None:
            first = x.slice(0, 1)
            yield edge(1, first)
        x = x if carried is None else pa.concat_tables([carried, x])
        lo, hi = x.column("lo").to_numpy(), x.column("hi").to_numpy()
        single = lo == hi
        same = np.zeros(len(lo), bool)
        same[1:] = single[1:] & single[:-1] & (lo[1:] == lo[:-1])
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(lo))))
        j = start - 1
        i = np.flatnonzero(j >= 0)
        yield rows(0, _extend(x, i, j[i]))
        last = x.slice(len(lo) - 1, 1)
        before = start[-1] - 1
        carried = pa.concat_tables([x.slice(before, 1), last]) if before >= 0 else last
    if last is not None:
        yield edge(2, last)


def _sorted_matches(contexts: DataFrame, by: list[str]) -> DataFrame:
    spark = contexts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ranges are told by gram and a few words of the context beyond it, so that short samples reach the driver. The words of the
    # gram itself begin each right context.
    begins = {"right": F.substring("right", 4 * GRAM + 1, 16), "left": F.substring("left", 1, 16)}[by[1]]
    placed = contexts.repartitionByRange(tasks, by[0], begins).sortWithinPartitions(*by)
    shape = "kind int, task int, gram long, full long, le long, re long, lo long, hi long, reach long, left binary, right binary"
    found = written(placed.mapInArrow(_neighbours, shape))
    # At most two rows for each task; the last of one meets the first of the next.
    edges = found.where("kind > 0").orderBy("task", "kind").select("kind", *COLUMNS).toArrow()
    kind = edges.column("kind").to_numpy()
    i = np.flatnonzero((kind[1:] == 1) & (kind[:-1] == 2)) + 1 if len(kind) else np.empty(0, np.int64)
    more = _extend(edges, i, i - 1) if len(i) else [np.empty(0, np.int64)] * 4
    out = found.where("kind = 0").select("gram", "full", "le", "re")
    if len(more[0]):
        out = out.unionByName(spark.createDataFrame(pa.table(dict(zip(["gram", "full", "le", "re"], more, strict=True)))))
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage of at least LEAST words that another document has too: id, start (in words from 0), n_words."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text")).where("doc is not null")
    rows = written(texts.mapInArrow(_suffixes, "doc long, pos int, gram long, full long, nl int, nr int, own int"))
    grams = rows.groupBy("gram").agg(F.min("doc").alias("a"), F.max("doc").alias("z"), F.min("full").alias("f"), F.max("full").alias("g"))
    # The small sides of the joins on hot keys are written: the planner may then split the other side's hot partitions.
    grams = written(grams.where("a < z").select("gram", (F.col("f") != F.col("g")).alias("mixed")))
    kept = written(rows.join(grams.hint("merge"), "gram"))
    alike = kept.groupBy("gram", "full").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(F.struct("doc", "pos")).alias("one"), F.first("nl").alias("nl"), F.first("nr").alias("nr"), F.first("own").alias("own"), F.first("mixed").alias("mixed"))
    alike = written(alike)

    # Contexts of one suffix of each kind, where a gram has several kinds.
    asked = alike.where("mixed").groupBy(F.col("one.doc").alias("d")).agg(F.collect_list(F.struct(F.col("one.pos").alias("pos"), "nl", "nr", "own", "gram", "full", "lo", "hi")).alias("asked"))
    first = texts.join(asked.hint("shuffle_hash"), F.col("doc") == F.col("d")).select("doc", "text", "asked").dropDuplicates(["doc"])
    contexts = written(first.select("text", "asked").mapInArrow(_contexts, CONTEXT))
    found = _sorted_matches(contexts, ["gram", "right", "left"]).unionByName(_sorted_matches(contexts, ["gram", "left", "right"]))
    whole = alike.where(f"lo < hi and nl + nr >= {LEAST}").select("gram", "full", F.col("nl").cast("long").alias("le"), F.col("nr").cast("long").alias("re"))
    best = written(found.unionByName(whole).unionByName(_window_matches(contexts)).groupBy("gram", "full").agg(F.max("le").alias("le"), F.max("re").alias("re")))
    spans = kept.join(best.hint("merge"), ["gram", "full"]).select("doc", (F.col("pos") - F.col("le")).alias("start"), (F.col("pos") + F.col("re")).alias("end"))
    order = Window.partitionBy("doc").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.withColumn("opens", F.when(F.col("start") <= reached, 0).otherwise(1))
    passages = opens.withColumn("passage", F.sum("opens").over(order)).groupBy("doc", "passage").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return passages.select(F.col("doc").alias(id_col), "start", (F.col("end") - F.col("start")).alias("n_words"))
