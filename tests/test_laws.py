"""Tag-list functions against plain-Python models on generated lists."""

import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tagloom.functions import tags as tg
from tagloom.functions.rules import Regex

TAGS = st.sampled_from(["a", "b", "ab", "é a", "x_y", r"q \(r\)", "日本", "a b", "quality"])
LISTS = st.lists(st.tuples(st.lists(TAGS, max_size=6), st.lists(TAGS, max_size=4)), min_size=1, max_size=40)
SLOW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def table(spark, cases):
    rows = [(i, a, b) for i, (a, b) in enumerate(cases)]
    return spark.createDataFrame(rows, "i int, a array<string>, b array<string>")


def model_prioritise(tags, patterns):
    tags, front = list(tags), []
    for p in patterns:
        hits = [t for t in tags if re.match(p, t)]
        front += hits
        tags = [t for t in tags if t not in hits]
    return front + tags


@SLOW
@given(LISTS)
def test_list_algebra(spark, cases):
    a, b = F.col("a"), F.col("b")
    out = table(spark, cases).select(
        "i",
        tg.unique(a).alias("unique"),
        tg.append_all(a, b).alias("plus"),
        tg.remove(a, b).alias("minus"),
        tg.keep(a, b).alias("both"),
        tg.union(a, b).alias("union"),
        tg.prioritise(a, ["a", r"\w+$"]).alias("front"),
        tg.keep(a, ["b", Regex(r"\w_")]).alias("kept"),
        tg.cut(a, 1, -1).alias("cut"),
        tg.pick(a, -2).alias("pick"),
    )
    for row in out.collect():
        x, y = cases[row.i]
        assert row.unique == list(dict.fromkeys(x))
        assert row.plus == x + y
        assert row.minus == [t for t in x if t not in y]
        assert row.both == [t for t in x if t in y]
        assert row.union == x + [t for t in y if t not in x]
        assert row.front == model_prioritise(x, ["a", r"\w+$"])
        assert row.kept == [t for t in x if t == "b" or re.match(r"\w_", t)]
        assert row.cut == x[1:-1]
        assert row.pick == (x[-2] if len(x) > 1 else None)
        assert sorted(row.minus + row.both) == sorted(x)
        assert row.union[: len(x)] == x


@SLOW
@given(LISTS)
def test_counted_replacement(spark, cases):
    out = table(spark, cases).select("i", *[tg.replace_text(F.col("a"), "a", "z", n).alias(f"n{n}") for n in (0, 1, 2)])

    def model(tags, count):
        done, result = 0, []
        for t in tags:
            new = t.replace("a", "z")
            if new != t and done < count:
                done, t = done + 1, new
            result.append(t)
        return result

    for row in out.collect():
        for n in (0, 1, 2):
            assert row[f"n{n}"] == model(cases[row.i][0], n)
