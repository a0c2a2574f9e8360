"""CSV against Python's csv module, JSON values by type, citations of any length."""

import csv
import io
import random

from pyspark.sql import functions as F

from quernstone.functions import structures as S
from quernstone.plans.dialect import SPARK, Dialect


def test_csv_against_the_csv_module(spark):
    r = random.Random(4)
    texts = ["", "\n", "\n\n", "a", "a\n", "a,b\n1,2", ",", ",\n", '"a,b",c\n', '"a""b"\n"x\ny",z\n', '"open', '"open\nend', '"a"b,c"d\n1', 'x,"y"\n\n\nz', '""', '"",""\n', "a\r\nb\r\n", None, '"' + 'x""' * 20_000 + '",b\n1,2', "é,ü\n" * 3000]
    for _ in range(3000):
        texts.append("".join(r.choice(['a', 'b', ',', ',', '"', '""', "\n", "\n", " ", "é"]) for _ in range(r.randint(0, 18))))
    rows = list(enumerate(texts))
    got = {x.id: (list(x.s.headers), x.s.row_count, x.s.column_count) for x in spark.createDataFrame(rows, "id long, t string").select("id", S.csv_structure(F.col("t")).alias("s")).collect()}
    bad = []
    for i, t in rows:
        parsed = list(csv.reader(io.StringIO(t or "", newline="")))
        head = parsed[0] if parsed else []
        # A quote that never closes: csv takes the end of the text as the end of the field, too.
        want = (head, max(0, len(parsed) - 1), len(head))
        if got[i] != want:
            bad.append((t, got[i], want))
    assert bad == []


def test_json_text(spark):
    values = {'"x"': "x", "1": "1", "1.5": "1.5", "false": "False", "null": "", "[]": "", '["a",null,["b",["c",["d"]]]]': 'a b c d', '{"parts":["a",1,null,"b"]}': "a b", '{"parts":"no list","k":1}': '{"k":1,"parts":"no list"}', "{}": "{}", "": "", "[1": ""}
    rows = [(k,) for k in values]
    got = {x.t: x.f for x in spark.createDataFrame(rows, "t string").selectExpr("t", f"{S.json_text('try_parse_json(t)')} AS f").collect()}
    assert got == values


def test_citations_of_any_length(spark):
    shown = spark.createDataFrame([("9" * 40,), ("007",), ("0",), ("x",), ("1.0",), (None,), (" +3 ",), ("-3",), ("",)], "t string").selectExpr("t", f"{S.plain_number(Dialect(SPARK), 't')} AS n")
    assert {x.t: x.n for x in shown.collect()} == {"9" * 40: "9" * 40, "007": "7", "0": "0", "x": None, "1.0": None, None: None, " +3 ": "3", "-3": None, "": None}


def test_character_vector(spark):
    v = spark.createDataFrame([("ab",), ("",), (None,)], "t string").select(S.character_vector(F.col("t")).alias("v")).collect()
    assert all(len(x.v) == 128 and abs(sum(c * c for c in x.v) - 1) < 1e-12 for x in v)
    level = (97 + 98) % 100 / 100
    assert abs(v[0].v[1] / v[0].v[0] - (level + 0.01) / level) < 1e-12


def test_csv_is_cut_once(spark):
    """Fields and ends are two passes over the text; all else reads what they found."""
    plan = spark.sql("SELECT 'a,b' || id AS t FROM range(3)").select(S.csv_structure(F.col("t")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(t#") == 2
