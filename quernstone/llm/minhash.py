"""MinHash near-duplicates by an inverted join on signature coordinates.

Documents with equal shingle sets are one class with a number. Each class posts its number under every (coordinate, value) pair of its
signature. Values that only one class has cannot collide; a class is active if enough of its values are shared. Of two
classes with at least MATCHES equal coordinates, both have one of these among their first COORDINATES - MATCHES + 1 in
the order of rarity, so only this prefix is merged. Merging goes in three steps, each over what is not connected yet:
a posting list links every member to its most central one; then each class takes its full set to a few of its longest
lists, where the members settle among themselves, in the order of collisions and skipping what is connected meanwhile; then
the lists propose the pairs left between different components. Lists are merged in blocks, so no task
holds a whole long list. Every link is confirmed on the full shingle sets, and only confirmed ones join components.

Defined results: null and empty texts have no shingles and are linked with nothing; fewer than five words are one
shingle; equal rows are in one class; each row is judged by its own text, so that rows of one id may be in several components;
rows without an id get no component; ids may be of any type that can be sorted; no rows give no rows. Shingles are told by
64-bit hashes of their words. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, text_or_empty, written

WIDTH, COORDINATES, MATCHES = 5, 128, 80
SIMILAR = (75, 100)
#: Members of a posting list that meet in one task.
BLOCK = 1500
#: Lists of so many members at least settle with full sets, and each class takes its set to so many of them.
LONG, HOMES = 32, 3
CACHED_WORDS = 500_000
_R = np.random.default_rng(20_240_311)
_ODD = (_R.integers(0, 2**32, COORDINATES, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _R.integers(0, 2**32, COORDINATES, dtype=np.uint32)[:, None]
_PLACE = _R.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, remembered within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def word_hashes(text: bytes) -> np.ndarray:
    """Of the words of a UTF-8 text, A-Z lower-cased; bytes know no other white space or capitals than ASCII's."""
    found = text.lower().split()
    return np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=len(found))


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of five words in a row; of all words if they are fewer."""
    n = len(words)
    if not n:
        return words
    if n < WIDTH:
        h = (words * _PLACE[:n]).sum(keepdims=True) + np.uint64(n)
    else:
        h = words[: n - WIDTH + 1] * _PLACE[0]
        for k in range(1, WIDTH):
            h += words[k : n - WIDTH + 1 + k] * _PLACE[k]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(h ^ (h >> np.uint64(29)))


def signature(s: np.ndarray) -> np.ndarray:
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(out, (_ODD * low[at : at + 4096][None, :] + _ADD).min(axis=1), out=out)
    return out


def _sketch(batches):
    for b in batches:
        ids, text_key, texts = b.column(0), b.column(1), b.column(2).cast(pa.binary())
        n, key, sig = [], [], []
        for t in texts:
            s = shingles(word_hashes(t.as_py()))
            n.append(len(s))
            key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([ids, text_key, pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["id", "text_key", "n", "set_key", "sig"])


def _sets(batches):
    for b in batches:
        texts = b.column(1).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.sort(shingles(word_hashes(t.as_py())).view(np.int64)) for t in texts], pa.list_(pa.int64()))], names=["id", "shingles"])


def _postings(batches):
    coord = np.arange(COORDINATES, dtype=np.int64) << 32
    for b in batches:
        ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), COORDINATES)
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array((sig.astype(np.int64) | coord).ravel())], names=["id", "token"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for the nodes of a, b edges: alternating large and small stars."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    while True:
        near = both(now)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = near.join(least.hint("merge"), F.col("a") == F.col("u")).where("b > a").select(F.col("m").alias("a"), "b")
        large = large.where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
        small = large.join(least.hint("merge"), F.col("b") == F.col("u"))
        small = small.select(F.col("m").alias("a"), "b").unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct()
        now = written(small)
        seen = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        # Done when all are stars: nobody is both over and under another, or under two.
        if seen.groupBy("node").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("up + down > 1").isEmpty():
            return now.select(F.col("b").alias("node"), F.col("a").alias("component"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of a, b pairs whose full sets are similar. A class that is in many pairs is dealt out with a salt for each few hundred of them."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / 300).cast("int").alias("salts"))
    left = sets.join(many.hint("shuffle_hash"), F.col("id") == F.col("a")).select("a", F.explode(F.sequence(F.lit(1), F.col("salts"))).alias("salt"), F.col("shingles").alias("sa"))
    salted = pairs.join(many.hint("merge"), "a").select("a", "b", (F.pmod(F.xxhash64("b"), F.col("salts")) + 1).cast("int").alias("salt"))
    right = salted.join(sets.hint("merge"), F.col("b") == F.col("id")).select("a", "b", "salt", F.col("shingles").alias("sb"))
    found = right.join(left.hint("merge"), ["a", "salt"])
    same, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    return found.where(SIMILAR[1] * same >= SIMILAR[0] * (total - same)).select("a", "b")


PAIRS = "a long, b long"


def _bits(rows: list, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(n, -1), axis=1)[:, :COORDINATES].astype(bool)


def _candidates(group: pa.Table, key, settled: bool):
    """For one block, or two, of a posting list: rows i, j of different components with enough collisions, and how many.
    settled: only under the first coordinate that is in the prefixes of both and collides, and if no list had both sets."""
    comp, size, block = (group.column(c).to_numpy() for c in ("component", "n", "block"))
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
    token, one, two = (k.as_py() for k in key)
    if settled:
        pre, home = _bits(group.column("prefix").to_pylist(), len(comp)), np.zeros((len(comp), COORDINATES), bool)
        for row, tokens in zip(home, group.column("homes").to_pylist(), strict=True):
            row[np.asarray(tokens or [], dtype=np.int64) >> 32] = True
    cols = np.flatnonzero(block == two)
    for i in np.flatnonzero(block == one):
        c = cols[cols > i] if one == two else cols
        c = c[(comp[c] != comp[i]) & (SIMILAR[1] * np.minimum(size[c], size[i]) >= SIMILAR[0] * np.maximum(size[c], size[i]))]
        if not len(c):
            continue
        equal = sig[c] == sig[i]
        hits = equal.sum(axis=1)
        ok = hits >= MATCHES
        if settled and ok.any():
            ok &= ((equal & pre[c] & pre[i]).argmax(axis=1) == token >> 32) & ~(equal & home[c] & home[i]).any(axis=1)
        if ok.any():
            yield np.full(int(ok.sum()), i), c[ok], hits[ok]


def _pairs(ids: np.ndarray, i, j) -> pa.Table:
    a, b = ids[np.asarray(i, dtype=np.int64)], ids[np.asarray(j, dtype=np.int64)]
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _propose(key, group):
    found = list(_candidates(group, key, True))
    i, j = (np.concatenate([f[k] for f in found]) if found else [] for k in (0, 1))
    return _pairs(group.column("id").to_numpy(), i, j)


def _settle(key, group):
    """Links between the components of one block, or two, of a list, as many as connect them."""
    found = list(_candidates(group, key, False))
    if not found:
        return _pairs(group.column("id").to_numpy(), [], [])
    i, j, hits = (np.concatenate([f[k] for f in found]) for k in range(3))
    comp, sets = group.column("component").to_pylist(), [x.values.to_numpy() for x in group.column("shingles")]
    root = {x: x for x in comp}

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    left, right = [], []
    for k in np.argsort(-hits, kind="stable"):
        x, y = top(comp[i[k]]), top(comp[j[k]])
        if x != y:
            a, b = sets[i[k]], sets[j[k]]
            at = np.searchsorted(a, b)
            same = int((a[np.minimum(at, len(a) - 1)] == b).sum())
            if SIMILAR[1] * same >= SIMILAR[0] * (len(a) + len(b) - same):
                root[x] = y
                left.append(i[k]), right.append(j[k])
    return _pairs(group.column("id").to_numpy(), left, right)


def _in_blocks(held: DataFrame) -> DataFrame:
    """Deals the members of each token's list over blocks, and each block out to every pair of blocks it is in."""
    held = held.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return held.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("other")


def _open(active: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the posting lists that still hold several components."""
    parts = components(links)
    held = active.join(parts.hint("merge"), F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    held = held.select("id", "n", "sig", "component", "prefix", F.explode("tokens").alias("token"))
    lists = held.groupBy("token").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("members > 1 and lo < hi")
    return held.join(lists.select("token", "members", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")).hint("merge"), "token")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id)."""
    return _judged(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: id, text_key, n, component_id, keep_key (of the text of smallest key among those of the component's
    smallest id)."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_key(text).alias("text_key"), text.alias("text"))
    sketched = written(rows.mapInArrow(_sketch, f"id {docs.schema[id_col].dataType.simpleString()}, text_key string, n long, set_key binary, sig binary"))
    usable = sketched.where("n > 0 and id is not null")
    classes = usable.groupBy("set_key").agg(F.min(F.struct("id", "text_key")).alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()))

    # One shuffle of the postings gives the frequency of each value; those of a single class go.
    posted = classes.select("id", "sig").mapInArrow(_postings, "id long, token long")
    often = F.count("*").over(Window.partitionBy("token"))
    shared = posted.withColumn("often", often).where("often > 1")
    per = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("values"), F.sum("often").alias("central"))
    active = per.where(F.size("values") >= MATCHES).join(classes.hint("shuffle_hash"), "id")
    length = F.greatest(F.lit(0), F.lit(COORDINATES - MATCHES + 1) - (F.lit(COORDINATES) - F.size("values")))
    active = active.withColumn("prefix", F.slice("values", 1, length)).select("id", "n", "sig", "central", F.transform("prefix", lambda x: x["token"]).alias("tokens"))
    active = written(active.mapInArrow(_with_prefix, "id long, n long, sig binary, central long, tokens array<long>, prefix binary"))

    # A class's set comes from the text that stands for it.
    wanted = classes.join(active.select("id").hint("shuffle_hash"), "id", "left_semi").select(F.col("id").alias("number"), F.col("least.id").alias("least_id"), F.col("least.text_key").alias("least_key"))
    texts = rows.join(wanted.hint("shuffle_hash"), (F.col("id") == F.col("least_id")) & (F.col("text_key") == F.col("least_key")))
    texts = texts.select(F.col("number").alias("id"), "least_id", "least_key", "text").dropDuplicates(["least_id", "least_key"]).select("id", "text")
    sets = written(texts.mapInArrow(_sets, "id long, shingles array<long>"))

    # Every member of a posting list with its most central one.
    listed = active.select("id", "n", "sig", "central", F.explode("tokens").alias("token"))
    heads = listed.groupBy("token").agg(F.max(F.struct("central", F.negative("id").alias("minus"))).alias("head"), F.count("*").alias("members")).where("members > 1")
    heads = written(heads.select("token", F.negative("head.minus").alias("head"), "members"))
    pairs = listed.select("token", "id").join(heads.hint("merge"), "token").where("id <> head")
    pairs = pairs.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    marked = active.select("id", "n", "sig")
    pairs = pairs.join(marked.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("siga")).hint("merge"), "a")
    pairs = pairs.join(marked.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sigb")).hint("merge"), "b")
    pairs = written(pairs.where(f"{SIMILAR[1]} * least(na, nb) >= {SIMILAR[0]} * greatest(na, nb)").mapInArrow(_enough, "a long, b long").distinct())
    links = written(_confirmed(pairs, sets))

    # Long lists settle with full sets.
    held = _open(active, links).where(F.col("members") >= LONG)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("members"), "token"))
    homes = written(held.withColumn("rank", rank).where(F.col("rank") <= HOMES).drop("rank", "members", "prefix"))
    full = _in_blocks(homes).join(sets.withColumnRenamed("id", "sid").hint("merge"), F.col("id") == F.col("sid")).drop("sid")
    links = links.unionByName(written(full.groupBy("token", "one", "two").applyInArrow(_settle, PAIRS)))

    # What is left between components, whose members never met with their sets.
    at_home = homes.groupBy("id").agg(F.collect_list("token").alias("homes")).withColumnRenamed("id", "hid")
    held = _open(active, links).join(at_home.hint("merge"), F.col("id") == F.col("hid"), "left").drop("hid", "members")
    found = _in_blocks(held).groupBy("token", "one", "two").applyInArrow(_propose, PAIRS).distinct()
    fresh = written(found.join(pairs.hint("shuffle_hash"), ["a", "b"], "left_anti"))
    links = links.unionByName(written(_confirmed(fresh, sets)))
    parts = components(links)
    named = classes.select("set_key", "least", "id").join(parts.hint("merge"), F.col("id") == F.col("node"), "left").select("set_key", "least", F.coalesce("component", "id").alias("component"))
    named = written(named)
    # Written, so that the planner may split the join where a component has very many classes.
    smallest = written(named.groupBy("component").agg(F.min("least").alias("keep")))
    named = written(named.join(smallest.hint("merge"), "component").select(F.col("set_key").alias("k"), "keep"))
    out = sketched.join(named.hint("merge"), F.col("set_key") == F.col("k"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("keep.id", "id"))
    return out.select("id", "text_key", "n", component.alias("component_id"), F.col("keep.text_key").alias("keep_key"))


def text_key(text):
    return F.md5(text.cast("binary"))


def _with_prefix(batches):
    """Adds the coordinates of the tokens as a bit set."""
    for b in batches:
        bits = np.zeros((b.num_rows, COORDINATES), dtype=np.uint8)
        for row, tokens in zip(bits, b.column("tokens").to_pylist(), strict=True):
            row[np.asarray(tokens, dtype=np.int64) >> 32] = 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], names=[*b.schema.names, "prefix"])


def _enough(batches):
    """Pairs with enough equal coordinates, from a, na, siga, b, nb, sigb."""
    for b in batches:
        one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES) for c in ("siga", "sigb"))
        ok = pa.array((one == two).sum(axis=1) >= MATCHES)
        yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id, and where this id has several such texts, that of the smallest
    digest. Rows without shingles or id stay, as do all columns."""
    lost = _judged(docs, id_col, text_col).where("n > 0 and id is not null and not (id <=> component_id and text_key <=> keep_key)")
    lost = lost.select(F.col("id").alias("lost_id"), F.col("text_key").alias("lost_key")).distinct()
    key = free_name([*docs.columns, "lost_id", "lost_key"], "text_key")
    alone = free_name([*docs.columns, "lost_id", "lost_key", key], "alone")
    own = docs.withColumn(key, text_key(text_or_empty(text_col)))
    # A number of its own for each row that no other can be a copy of; all others count by id and text.
    free = F.col(id_col).isNull() | ~text_or_empty(text_col).rlike(WORD)
    own = own.withColumn(alone, F.when(free, F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    held = own.join(lost.hint("shuffle_hash"), (own[id_col] == lost["lost_id"]) & (own[key] == lost["lost_key"]), "left_anti")
    return held.dropDuplicates([id_col, key, alone]).drop(key, alone)
