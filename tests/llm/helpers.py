"""Small documents with every awkward case, and plain Python versions to hold results against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, size long, block string"


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows(seed=7, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeüéño") for _ in range(r.randint(1, 7))) for _ in range(300)]
    prose = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    base = [prose(r.randint(3, 160)) for _ in range(n)]
    texts = [*base, base[0], base[0].upper(), base[1].title(), None, None, "", " \n\t ", "É", "é", "a", "A", "one two three four", base[2] + " tail", "x " * 200, "x " * 200 + "\n", "Line one here\nLine one here\nother\n" * 20, "\x1cword\u00a0joined\x0bsplit", prose(3000), "# * $ % & | < >", base[3] + "\n" + base[3]]
    out = [(i, t, ["en", None][i % 9 == 0], None if i % 7 == 3 else f"s{i % 4}", None, "n", 1, "b") for i, t in enumerate(texts)]
    return out + [out[5], out[5], (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def tokens_with_id(got):
    return sorted(got, key=repr)
