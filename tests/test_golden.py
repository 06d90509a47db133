"""Before/after rows of the caption edits, and their edge cases."""

import pytest
from pyspark.sql import functions as F

from tagloom.functions import derived as dv, normal, tags as tg
from tagloom.functions.rules import Regex, java_regex, java_replacement
from tagloom.operators import dictionary as dc

SETS = {"character": ["ganyu_(genshin_impact)", "honma_meiko"], "style": ["3d"], "artist": ["some_artist"]}

LADDER = [(0, "count", r"\d\+?(?:boy|girl)s?"), (1, "character", "character:.*"), (2, "hair", ".* hair")]


def split(text):
    return text.split(", ") if text else []


CASES = [
    ("add in front", lambda t: tg.add(t, ["long hair"]), "1girl, blonde hair, blue eyes", "long hair, 1girl, blonde hair, blue eyes"),
    ("add existing", lambda t: tg.add(t, ["long hair"]), "1girl, blonde hair, long hair, blue eyes", "long hair, 1girl, blonde hair, blue eyes"),
    ("append", lambda t: tg.add(t, ["long hair"], append=True), "1girl, blonde hair, blue eyes", "1girl, blonde hair, blue eyes, long hair"),
    ("remove", lambda t: tg.remove(t, "long hair"), "1girl, blonde hair, long hair, blue eyes", "1girl, blonde hair, blue eyes"),
    ("remove regex", lambda t: tg.remove(t, Regex(".* hair")), "blonde hair, long hair, blue eyes", "blue eyes"),
    ("remove artist", lambda t: dv.remove_type(dv.typed(t, SETS), "artist"), "artist: xxx, 1girl", "1girl"),
    ("replace tag", lambda t: tg.replace_tag(t, "long hair", "short hair"), "1girl, blonde hair, long hair, blue eyes", "1girl, blonde hair, short hair, blue eyes"),
    ("replace regex", lambda t: tg.substitute(t, r"(.*) hair", r"\1 ponytail"), "blonde hair, long hair, blue eyes", "blonde ponytail, long ponytail, blue eyes"),
    ("replace text", lambda t: tg.replace_text(t, "long hair", "ponytail"), "long hair, very long hair", "ponytail, very ponytail"),
    ("parse", lambda t: dv.prefix_metatags(dv.typed(t, SETS)), "ganyu (genshin impact), blue hair", "character: ganyu (genshin impact), blue hair"),
    ("sort", lambda t: dc.sort_by_priority(t, dc.ladder_priority(LADDER)), "blue hair, 1girl, character: xxx", "1girl, character: xxx, blue hair"),
    ("unique", tg.unique, "1girl, blonde hair, blue eyes, blonde hair", "1girl, blonde hair, blue eyes"),
    ("formalise", lambda t: dv.formalise(dv.typed(t, SETS)), "honma meiko, by xxx, 3d", "character: honma meiko, artist: xxx, style: 3d"),
    ("deformalise", dv.deformalise, "character: honma meiko, artist: xxx, style: 3d", "honma meiko, by xxx, 3d"),
    ("underline", tg.underlined, "blonde hair, blue eyes", "blonde_hair, blue_eyes"),
]


@pytest.mark.parametrize("name,function,before,after", CASES, ids=[c[0] for c in CASES])
def test_golden(evaluate, name, function, before, after):
    assert evaluate(function, split(before)) == [split(after)]


def test_deoverlap_and_defeature(spark, tagged):
    overlap = spark.createDataFrame(
        [
            ("very_long_hair", [], ["long_hair"]),
            ("absurdly_long_hair", [], ["long_hair", "very_long_hair"]),
        ],
        "query string, parents array<string>, children array<string>",
    )
    df = tagged(["long hair", "very long hair", "absurdly long hair"], None, [], ["long_hair", "Very Long Hair", "Long hair"])
    for limit in (dc.INLINE_PAIRS, 0):
        out = {r.image_key: r.tags for r in dc.deoverlap(df, overlap, inline_limit=limit).collect()}
        assert out == {"k0": ["absurdly long hair"], "k1": None, "k2": [], "k3": ["Very Long Hair"]}

    features = spark.createDataFrame(
        [("honma meiko", "long hair"), ("honma_meiko", "blue_eyes"), ("other", "lolita dress")], "character string, feature string"
    )
    records = tagged(["honma meiko", "long hair", "blue eyes", "lolita dress"], ["long hair"], None).withColumn(
        "characters", F.when(F.col("ord") == 0, F.array(F.lit("honma meiko")))
    )
    out = {r.image_key: r.tags for r in dc.defeature(records, features).collect()}
    assert out == {"k0": ["honma meiko", "lolita dress"], "k1": ["long hair"], "k2": None}


def test_parse_caption(spark):
    rows = [(0, "a，b, c ,, d"), (1, "a,b"), (2, ""), (3, None), (4, "  x \t, 　y ")]
    df = spark.createDataFrame(rows, "i int, c string").select("i", tg.parse(F.col("c")).alias("t"), tg.parse(F.col("c"), sep=",").alias("s"))
    out = {r.i: (r.t, r.s) for r in df.collect()}
    assert out[0] == (["a,b", "c ,", "d"], ["a", "b", "c", "d"])
    assert out[1] == (["a,b"], ["a", "b"])
    assert out[2] == ([], [])
    assert out[3] == (None, None)
    assert out[4][0] == ["x", "y"]


def test_counts(evaluate):
    tags = ["aa", "b", "aa", "ab"]
    assert evaluate(lambda t: tg.replace_text(t, "a", "z", 0), tags) == [tags]
    assert evaluate(lambda t: tg.replace_text(t, "a", "z", 1), tags) == [["zz", "b", "aa", "ab"]]
    assert evaluate(lambda t: tg.replace_text(t, "a", "z", 2), tags) == [["zz", "b", "zz", "ab"]]
    assert evaluate(lambda t: tg.replace_tag(t, "aa", "z", 1), tags) == [["z", "b", "aa", "ab"]]
    assert evaluate(lambda t: tg.replace_tag(t, "aa", "z", 0), tags) == [tags]
    assert evaluate(lambda t: tg.substitute(t, "a", "", -1), tags) == [["b", "b"]]


def test_union_keeps_order_and_duplicates(evaluate):
    assert evaluate(lambda t: tg.union(t, ["c", "a", "c"]), ["a", "b", "a"]) == [["a", "b", "a", "c", "c"]]
    assert evaluate(lambda t: tg.union(t, ["x"]), None, []) == [None, ["x"]]


def test_normal_forms(spark):
    tags = ["Artist: Some Name ", r"ganyu \(genshin impact\)", "_A_b_", "character: X Y", "style:z", "a: b", r"x\y z"]
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    pick = lambda f: [r.o for r in df.select(f(F.col("t")).alias("o")).collect()]
    assert pick(normal.underscore_form) == ["some_name", "ganyu_(genshin_impact)", "a_b", "x_y", "z", "a:b", r"x\y_z"]
    assert pick(normal.space_form) == ["some name", r"ganyu \(genshin impact\)", "a b", "x y", "z", "a:b", r"x\y z"]
    assert pick(normal.priority_form)[1] == "ganyu_(genshin_impact)"


def test_weights_and_escapes(evaluate):
    tags = ["(a:1.2)", "(abc)", r"x \(y\)", "[z]", "(a)(b)"]
    assert evaluate(tg.unweighted, tags) == [["a", "abc", r"x \(y\)", "[z]", "a)(b"]]
    assert evaluate(tg.escaped, tags)[0][2:4] == [r"x \(y\)", r"\[z\]"]
    assert evaluate(lambda t: tg.unescaped(tg.escaped(t)), ["(a)", "[z]"]) == [["(a)", "[z]"]]


def test_artist_and_quality(evaluate):
    lists = [["artist: a b", "x"], ["x", "by c_d (e)"], ["x"], None, ["best quality", "low_quality"]]
    assert evaluate(dv.artist, *lists) == ["a b", "c_d (e)", None, None, None]
    assert evaluate(dv.quality, *lists)[4] == "best"
    assert evaluate(lambda t: dv.with_quality(t, "high"), *lists)[2:] == [
        ["high quality", "x"], ["high quality"], ["high quality", "high_quality"],
    ]
    assert evaluate(lambda t: dv.with_quality(t, None), ["x", "best quality"], ["x"]) == [["x"], ["x"]]
    renamed = evaluate(lambda t: dv.with_artist(dv.typed(t, {}), "new"), *lists)
    assert renamed[:3] == [["artist: new", "x"], ["x", "by new"], ["artist: new", "x"]]
    assert evaluate(lambda t: dv.with_artist(dv.typed(t, {}), F.lit(None).cast("string")), ["x"]) == [["x"]]


def test_only_last_artist_is_prefixed(evaluate):
    sets = {"artist": ["a", "b"], "character": ["c"]}
    assert evaluate(lambda t: dv.prefix_metatags(dv.typed(t, sets)), ["a", "b", "c", "b", "c"]) == [
        ["a", "artist: b", "character: c", "b", "character: c"]
    ]


def test_templates(evaluate):
    folder, stem = F.lit("cat"), F.lit("stem")
    assert evaluate(lambda t: tg.add(t, ["%dir% %stem%"], category=folder, stem=stem), []) == [["cat stem"]]
    with pytest.raises(ValueError):
        tg.fill_template("%unknown%", folder, stem)


def test_regex_translation():
    assert java_regex(r"(?P<x>a)(?P=x)\Z") == r"(?<x>a)\k<x>\z"
    assert java_replacement(r"\1 costs $5 \g<2>") == r"$1 costs \$5 $2"


def test_regex_is_anchored_and_unicode(evaluate):
    assert evaluate(lambda t: tg.keep(t, Regex(r"\w+$")), ["日本", "a b", "ab"]) == [["日本", "ab"]]
    assert evaluate(lambda t: tg.keep(t, Regex("b|c")), ["ab", "bc", "c"]) == [["bc", "c"]]
