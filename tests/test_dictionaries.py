"""Terms in texts and the index in ten categories against plain Python with a pattern for each rule."""

import os
import random
import re
from collections import Counter, defaultdict

import pytest

from quernstone.operators import dictionaries as D
from quernstone.plans.dialect import SPARK, Dialect
from quernstone.views import run_sql

DATA = "/root/testdata/sf0.001"


def terms_in(text):
    """The rule: the term between two word boundaries, whatever the case."""
    return sorted((kind, t) for kind, ts in D.ENTITIES.items() for t in ts if re.search(r"\b" + re.escape(t) + r"\b", text, re.IGNORECASE))


def test_every_term_in_every_surrounding(spark):
    terms = [t for ts in D.ENTITIES.values() for t in ts]
    r, signs = random.Random(3), [" ", "", ".", "-", "x", "7", "_", "é", "  ", "\n", ", ", "+", "#"]
    texts = [a + t + b for t in terms for a in ("", " ", "x", ".") for b in ("", " ", "s", "1", "!", "_")]
    texts += ["".join(r.choice([*terms, "go", "on", "rails", "next", "js", "tim"]).upper() + r.choice(signs) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    texts += [None, "", " ", "C++", "C++x", "c++ c++", "ruby on  rails", "ruby\non rails", "Tim-Berners-Lee", "word " * 20_000 + "ibm"]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "id long, content string").createOrReplaceTempView("own_texts")
    got = defaultdict(list)
    for x in spark.sql(D.gazetteer(Dialect(SPARK), "SELECT * FROM own_texts", "id")).collect():
        got[x.id].append((x.type, x.term))
    assert [(t, sorted(got[i]), terms_in(t or "")) for i, t in rows if sorted(got[i]) != terms_in(t or "")] == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_index_against_plain_python(spark):
    texts = defaultdict(list)
    for m in sorted(run_sql(spark, DATA, "SELECT conv_id, msg_index, content FROM v_chat").collect()):
        texts[m.conv_id] += [m.content] if m.content else []
    want = set()
    for conv, parts in texts.items():
        text = " ".join(parts)
        want |= {("urls", u, conv) for u in re.findall(r'https?://[^\s<>"]+|www\.[^\s<>"]+', text)}
        want |= {("file_names", f, conv) for f in re.findall(rf"\b[\w\-.]+\.(?:{'|'.join(D.INDEX_FILES)})\b", text.lower())}
        want |= {("dates", x, conv) for x in re.findall(r"\b(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4})\b", text)}
        for word, n in Counter(re.findall(r"\b[a-zA-Z]{2,}\b", text.lower())).items():
            kinds = [k for k, ws in D.INDEX.items() if word in ws]
            want |= {(c, word, conv) for k in kinds for c in (k, D.ALSO[k])}
            if not kinds and word not in D.STOP_WORDS and len(word) > 2 and n >= 2:
                want.add(("keywords", word, conv))
        if "oracle compiler" in text.lower():
            want.add(("projects", "oracle compiler", conv))
    got = [tuple(r) for r in run_sql(spark, DATA, D.index(Dialect(SPARK))).select("category", "token", "conv_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {c for c, _, _ in got} >= {"keywords", "technologies", "programming_languages", "frameworks", "products", "companies", "file_names", "urls", "dates", "projects"}


def test_display_names(spark):
    shown = {r.t: r.n for r in spark.sql(f"SELECT t, {D.display(Dialect(SPARK), 't')} AS n FROM VALUES ('node'), ('react'), ('gitHub'), ('SOMETHING'), ('') AS v(t)").collect()}
    assert shown == {"node": "Node.js", "react": "React", "gitHub": "GitHub", "SOMETHING": "Something", "": ""}
