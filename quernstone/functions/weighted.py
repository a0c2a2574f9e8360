"""Weighted search of many requests at once over objects, conversations, entities and attachments.

A request scores where its whole text, or one of its words, stands in a field, also inside other words. A word without blanks stands in a
text exactly if it stands in one of the text's words, so requests are matched with the vocabulary, not with the texts: each distinct word
is posted under its pieces of one to three letters, a request's word is looked up under itself or its rarest piece of three, and what is
found is verified. Texts then meet request words over their own words, as equal values. Whole requests are verified only in fields that
hold all their words.

Requests of up to SENT_WORDS words go to every task, and texts stay where they are: a task looks up what stands in a text's words and sends
on one packed row a field, of the requests that score there. Only more requests than that make words and texts travel."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dictionaries import entities
from ..plans.dialect import SPARK, Dialect, Registry
from ..streaming.folders import shared_folder
from ..views import run_sql

R = Registry()

#: By type and field, the weight of the whole request and of each of its words. An entity scores 4, an attachment in
#: which only words are found 2, once each.
WEIGHTS = {("knowledge", "title"): (10, 3), ("knowledge", "content"): (5, 1), ("knowledge", "conversation"): (2, 0), ("conversation", "title"): (8, 2), ("conversation", "first"): (4, 1), ("attachment", "name"): (7, 0), ("attachment", "summary"): (3, 0)}
ENTITY, WORDS_ONLY = 4, 2
#: Requests' words up to this number are sent to every task, some 60 bytes each; more are shuffled.
SENT_WORDS = 200_000
#: Words whose finds a task remembers, and rows of a batch that it gives back.
REMEMBERED, BATCH_ROWS = 100_000, 50_000
PIECE = 3

BLANKS = r"[\p{Z}\x09-\x0D]+"
#: What BLANKS leaves, for Python, which has no classes by category.
WORD = re.compile("[^\\x09-\\x0D\\x20\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def fields(d: Dialect) -> str:
    """type, id, field, text: all that is searched, in lower case. Objects without a title go by their id."""
    first = "min_by(content, ord)" if d.spark else "arg_min(content, ord)"
    low = "lower(coalesce(nullif({0}, ''), {1}))".format
    return f"""
SELECT 'knowledge' AS type, object_id AS id, 'title' AS field, {low('title', 'object_id')} AS text FROM v_objects UNION ALL SELECT 'knowledge', object_id, 'content', lower(content) FROM v_objects
UNION ALL SELECT 'knowledge', object_id, 'conversation', CAST(conversation_id AS {d.text}) FROM v_objects
UNION ALL SELECT 'conversation', CAST(conv_id AS {d.text}), 'title', {low('title', f'CAST(conv_id AS {d.text})')} FROM v_conversations
UNION ALL SELECT 'conversation', CAST(conv_id AS {d.text}), 'first', lower({first}) FROM v_messages WHERE role = 'user' GROUP BY conv_id
UNION ALL SELECT DISTINCT 'entity', concat(type, ':', value, '@', CAST(conv_id AS {d.text})), 'value', lower(value) FROM ({entities(d)}) e
UNION ALL SELECT 'attachment', attachment_id, 'name', lower(file_name) FROM v_attachments UNION ALL SELECT 'attachment', attachment_id, 'summary', lower(url) FROM v_attachments"""


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _pieces(word: Column) -> Column:
    """The distinct pieces of one to three letters of a word."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    of = lambda k: F.when(F.size(letters) >= k, F.transform(F.sequence(F.lit(1), F.size(letters) - k + 1), lambda i: F.array_join(F.slice(letters, i, k), ""))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(k) for k in range(1, PIECE + 1)]))


class _Folder:
    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, shared_folder(spark), 0

    def written(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def found_words(vocabulary: DataFrame, asked: DataFrame, folder: _Folder) -> DataFrame:
    """word, token for each word of a vocabulary and each asked token that stands in it."""
    posted = folder.written(vocabulary.select("word", F.explode(_pieces(F.col("word"))).alias("piece")))
    often = posted.groupBy("piece").agg(F.count("*").alias("n"))
    # Short tokens are pieces themselves; a longer one is looked up under its rarest piece of three.
    short = asked.where(F.length("token") <= PIECE).select("token", F.col("token").alias("piece"))
    keys = asked.where(F.length("token") > PIECE).select("token", F.explode(F.filter(_pieces(F.col("token")), lambda p: F.length(p) == PIECE)).alias("piece"))
    keys = keys.join(often.hint("merge"), "piece").groupBy("token").agg(F.min(F.struct("n", "piece")).alias("rarest"), F.count("*").alias("met"), F.max(F.size(F.filter(_pieces(F.col("token")), lambda p: F.length(p) == PIECE))).alias("all"))
    keys = folder.written(keys.where("met = all").select("token", "rarest.piece").unionByName(short))
    sent = F.broadcast(keys) if keys.count() <= SENT_WORDS else keys.hint("merge")
    return posted.join(sent, "piece").where(F.contains("word", "token")).select("word", "token")


class _Requests:
    """Requests in a task: the ids of their distinct words, and for each word the requests that have it and how often."""

    def __init__(self, terms: list[str]):
        self.terms, self.ids, met = terms, {}, []
        for r, term in enumerate(terms):
            times: dict[int, int] = {}
            for w in WORD.findall(term):
                t = self.ids.setdefault(w, len(self.ids))
                times[t] = times.get(t, 0) + 1
            met += [(t, r, n) for t, n in times.items()]
        table = np.array(sorted(met), np.int64).reshape(-1, 3)
        self.request, self.times = table[:, 1], table[:, 2]
        self.start = np.searchsorted(table[:, 0], np.arange(len(self.ids) + 1))
        self.needed = np.bincount(self.request, minlength=len(terms))
        self.lengths, self.longer, self.seen = sorted({len(w) for w in self.ids if len(w) <= PIECE}), {}, {}
        for w in self.ids:
            if len(w) > PIECE:
                self.longer.setdefault(w[:PIECE], set()).add(len(w))

    def _inside(self, word: str) -> tuple[int, ...]:
        """The request words that stand in a word."""
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            parts = [word[i : i + n] for n in self.lengths for i in range(len(word) - n + 1)]
            parts += [word[i : i + n] for i in range(len(word) - PIECE) for n in self.longer.get(word[i : i + PIECE], ())]
            got = self.seen[word] = tuple({self.ids[x] for x in parts if x in self.ids})
        return got

    def score(self, text: str, whole: int, each: int, any_: bool) -> bytes:
        """The requests that score in a text, and their scores, as 32-bit numbers; with any_ also those that score nothing."""
        tokens: set[int] = set()
        for w in set(WORD.findall(text)):
            tokens.update(self._inside(w))
        if not tokens:
            return b""
        t = np.fromiter(tokens, np.int64, len(tokens))
        n = self.start[t + 1] - self.start[t]
        at = np.repeat(self.start[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
        request = self.request[at]
        kinds = np.bincount(request, minlength=len(self.terms))
        score = each * np.bincount(request, self.times[at], len(self.terms)).astype(np.int64)
        for r in np.flatnonzero(kinds == self.needed) if whole else ():
            score[r] += whole * (self.terms[r] in text)
        found = np.flatnonzero(kinds > 0 if any_ else score > 0)
        return np.concatenate([found, score[found]]).astype(np.int32).tobytes()


def _met(asked: pa.Table, searched: DataFrame) -> DataFrame:
    """type, id, packed: for each field in which anything is found the requests, by number, and their scores."""
    terms = asked.column("term").to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        requests = _Requests(terms)
        for b in batches:
            packed = [requests.score(x.as_py(), *WEIGHTS.get((t, f), (0, 0)), t in ("entity", "attachment")) for t, f, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["type", "id", "packed"]).filter(pa.array([p != b"" for p in packed], pa.bool_()))

    return searched.where("text <> ''").select(F.col("type").cast("string"), F.col("id").cast("string"), F.col("field").cast("string"), "text").mapInArrow(run, "type string, id string, packed binary").where("packed <> X''")


def _unpacked(asked: pa.Table, met: DataFrame, by: list[str], item_type: str) -> DataFrame:
    """item_id, by, score: the sums of all fields of a group; only packed rows travel."""
    items = asked.column("item_id").combine_chunks()
    values = items.unique()
    number = items.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            size = 0
            for i, packed in enumerate(b.column(len(by))):
                parts = [np.frombuffer(p, np.int32).reshape(2, -1) for p in packed.as_py()]
                of, score = number[np.concatenate([p[0] for p in parts])], np.concatenate([p[1] for p in parts])
                found, at = np.unique(of, return_inverse=True)
                out.append((np.full(len(found), i), found, np.bincount(at, score, len(found)).astype(np.int64)))
                size += len(found)
                if size >= BATCH_ROWS or i == b.num_rows - 1:
                    row, item, score = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([values.take(pa.array(item)), *[b.column(k).take(pa.array(row)) for k in range(len(by))], pa.array(score)], names=["item_id", *by, "score"])
                    out, size = [], 0

    grouped = met.groupBy(*by).agg(F.collect_list("packed").alias("packed"))
    return grouped.mapInArrow(run, f"item_id {item_type}, {', '.join(f'{c} string' for c in by)}, score long")


def _asked(requests: DataFrame) -> DataFrame:
    term = F.regexp_replace(F.lower("text"), rf"^{BLANKS}|{BLANKS}$", "")
    return requests.select("item_id", term.alias("term")).where("term <> ''")


def _few(asked: DataFrame) -> bool:
    return (asked.agg(F.sum(F.size(_words(F.col("term"))))).first()[0] or 0) <= SENT_WORDS


def _score(found: DataFrame) -> DataFrame:
    score = F.when(F.col("type") == "entity", ENTITY).when((F.col("type") == "attachment") & (F.col("score") == 0), WORDS_ONLY).otherwise(F.col("score"))
    return found.select("item_id", "type", "id", score.cast("long").alias("score")).where("score > 0")


def search(requests: DataFrame, searched: DataFrame) -> DataFrame:
    """requests: item_id, text; searched: type, id, field, text (lower case). item_id, type, id, score wherever anything is found.

    Empty requests and null fields find nothing; a word that a request has twice counts twice; equal fields of one id count once each."""
    asked = _asked(requests)
    if not _few(asked):
        return _search_many(asked, searched)
    local = asked.toArrow()
    return _score(_unpacked(local, _met(local, searched), ["type", "id"], requests.schema["item_id"].dataType.simpleString()))


def search_ids(requests: DataFrame, searched: DataFrame) -> DataFrame:
    """item_id, id of what search finds, once each, whatever its types."""
    asked = _asked(requests)
    if not _few(asked):
        return _search_many(asked, searched).select("item_id", "id").distinct()
    local = asked.toArrow()
    return _unpacked(local, _met(local, searched), ["id"], requests.schema["item_id"].dataType.simpleString()).drop("score")


def _search_many(asked: DataFrame, searched: DataFrame) -> DataFrame:
    """search() where the requests are too many for a task."""
    folder = _Folder(asked.sparkSession)
    asked = folder.written(asked)
    tokens = folder.written(asked.select("item_id", F.explode(_words(F.col("term"))).alias("token")).groupBy("item_id", "token").agg(F.count("*").alias("times")))
    rows = folder.written(searched.where("text <> ''").select(F.monotonically_increasing_id().alias("row"), "type", "id", "field", "text"))
    words = folder.written(rows.select("row", F.explode(F.array_distinct(_words(F.col("text")))).alias("word")))
    pairs = folder.written(found_words(words.select("word").distinct(), tokens.select("token").distinct(), folder))
    met = words.join(pairs.hint("merge"), "word").select("row", "token").distinct()
    sent = F.broadcast(tokens) if tokens.count() <= SENT_WORDS else tokens.hint("merge")
    # One row for each field and request: how often its words are found, and how many of them.
    hits = met.join(sent, "token").groupBy("row", "item_id").agg(F.sum("times").alias("hits"), F.count("*").alias("kinds"))
    needed = tokens.groupBy("item_id").agg(F.count("*").alias("needed"))
    needed = asked.join(needed.hint("merge"), "item_id")
    hits = folder.written(hits)
    all_found = hits.join(needed.hint("shuffle_hash"), "item_id").where("kinds = needed").select("row", "item_id", "term")
    whole = folder.written(all_found.join(rows.select("row", "text").hint("merge"), "row").where(F.contains("text", "term")).select("row", "item_id", F.lit(1).alias("whole")))
    scored = hits.join(whole.hint("merge"), ["row", "item_id"], "left").join(rows.drop("text").hint("merge"), "row")
    of = lambda at: F.coalesce(*[F.when((F.col("type") == t) & (F.col("field") == f), F.lit(w[at])) for (t, f), w in WEIGHTS.items()], F.lit(0))
    scored = scored.groupBy("item_id", "type", "id").agg(F.sum(of(0) * F.coalesce("whole", F.lit(0)) + of(1) * F.col("hits")).alias("score"))
    return _score(scored)


def results(spark: SparkSession, sf_dir: str, how=search) -> DataFrame:
    """Every benchmark text as a request."""
    return how(run_sql(spark, sf_dir, "SELECT item_id, text FROM benchmark"), run_sql(spark, sf_dir, fields(Dialect(SPARK))))


@R.add("qry_weighted_search")
def _(d: Dialect) -> str:
    """The check: every request against every field, by containment."""
    cases = lambda at: "CASE " + " ".join(f"WHEN type = '{t}' AND field = '{f}' THEN {w[at]}" for (t, f), w in WEIGHTS.items()) + " ELSE 0 END"
    return f"""
SELECT item_id, type, id, CAST(CASE WHEN type = 'entity' THEN {ENTITY} WHEN type = 'attachment' AND s = 0 THEN {WORDS_ONLY} ELSE s END AS BIGINT) AS score FROM
(SELECT item_id, type, id, sum(({cases(0)}) * CASE WHEN contains(text, term) THEN 1 ELSE 0 END + ({cases(1)}) * hits) AS s, sum(hits) AS h FROM
(SELECT q.item_id, q.term, f.type, f.id, f.field, f.text, len(list_filter(q.words, lambda w: contains(f.text, w))) AS hits FROM ({fields(d)}) f,
(SELECT item_id, term, list_filter(regexp_split_to_array(term, '{BLANKS}'), lambda w: w <> '') AS words FROM (SELECT item_id, regexp_replace(lower(text), '^{BLANKS}|{BLANKS}$', '', 'g') AS term FROM benchmark) b) q WHERE f.text <> '') m
GROUP BY item_id, type, id HAVING h > 0) t WHERE score > 0"""


@R.add("set_search_union")
def _(d: Dialect) -> str:
    """What a request finds, of all four types, by id alone."""
    return f"SELECT item_id, id FROM ({R['qry_weighted_search'](d)}) s WHERE type = 'knowledge' UNION SELECT item_id, id FROM ({R['qry_weighted_search'](d)}) s WHERE type <> 'knowledge'"


@R.add("agg_search_tabs")
def _(d: Dialect) -> str:
    return f"SELECT item_id, type, count(*) AS n FROM ({R['qry_weighted_search'](d)}) s GROUP BY item_id, type"


@R.add("top_context")
def _(d: Dialect) -> str:
    """The six best results of a request, whatever their type."""
    return f"SELECT item_id, type, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, type, id) AS place FROM ({R['qry_weighted_search'](d)}) s) t WHERE place <= 6"


def best(found: DataFrame, k: int = 6) -> DataFrame:
    """The k best results of each request; Spark keeps the k best of each task before it brings a request's results together."""
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "type", "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


QUERIES = {
    "qry_weighted_search": results,
    "set_search_union": lambda spark, sf_dir: results(spark, sf_dir, search_ids),
    "agg_search_tabs": lambda spark, sf_dir: results(spark, sf_dir).groupBy("item_id", "type").agg(F.count("*").alias("n")),
    "top_context": lambda spark, sf_dir: best(results(spark, sf_dir)),
}
