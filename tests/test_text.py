import fnmatch

import pytest
from pyspark.sql import functions as F

from plantweave.functions import scoring, semantics, text, types


def column(spark, values, fn):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, s string")
    return [r.r for r in df.select("i", fn(F.col("s")).alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("My Device Name", "My_Device_Name"), ("Sensor+Temperature", "Sensor_Temperature"), ("Level/Sub", "Level_Sub"),
        ("a#b", "a_b"), ("  x \t\n y  ", "x_y"), ("__a__b__", "a_b"), ("", "unnamed"), ("+++", "unnamed"),
        (None, "unnamed"), ("a\x00b", "a_b"), ("a  b", "a_b"), ("a\x1cb", "a_b"),
        ("Café", "Café"), ("日本 語", "日本_語"), ("x" * 200, "x" * 64),
        ("a" * 40 + " " + "b" * 40, "a" * 40), ("../../etc", ".._.._etc"),
    ],
)
def test_segment(spark, raw, clean):
    assert column(spark, [raw], text.sanitize_segment) == [clean]


def test_paths_both_ways(spark):
    got = column(spark, ["A.B[0].C", "List[10].Value", "Config.123.Name", "L[0][1]"], text.sanitize_metric_path)
    assert got == ["A/B/a0a/C", "List/a10a/Value", "Config/123/Name", "L/a0a/a1a"]
    back = column(spark, ["List/a0a/Value", "Config/123/Name", "Config/idx_1/Name", "A/a2a/a3a"], text.topic_path_to_api_path)
    assert back == ["List[0].Value", "Config.123.Name", "Config.idx_1.Name", "A[2][3]"]
    assert column(spark, ["Acme/Plant A//Line+1/Robot", ""], text.sanitize_topic) == ["Acme/Plant_A/Line_1/Robot", "unnamed"]


GLOBS = ["*/Setpoints/*", "a?c", "[ab]x*", "[!ab]x", "a.b+(c)", "*", "user-1*", "[]x]y", "a[^b]c"]
NAMES = ["X/Setpoints/Y/Z", "abc", "axq", "bx", "cx", "a.b+(c)", "user-12", "]y", "xy", "a^c", "abc\n", ""]


@pytest.mark.parametrize("glob", GLOBS)
def test_glob_agrees_with_shell_rules(spark, glob):
    want = [fnmatch.fnmatchcase(n, glob) for n in NAMES]
    assert column(spark, NAMES, lambda c: c.rlike(text.glob_to_regex(glob))) == want


@pytest.mark.parametrize(
    "pattern, topic, hit",
    [
        ("a/+/c", "a/b/c", True), ("a/+/c", "a/b/d/c", False), ("a/#", "a", True), ("a/#", "a/b/c", True),
        ("#", "a/b", True), ("#", "$SYS/x", False), ("+/b", "/b", True), ("a/b", "a/b/c", False), ("$SYS/#", "$SYS/x", True),
    ],
)
def test_topic_filter(spark, pattern, topic, hit):
    assert column(spark, [topic], lambda c: c.rlike(text.topic_filter_to_regex(pattern))) == [hit]


def test_semantic_identifiers(spark):
    ids = ["0173-1#02-AAO677#002", "0112/2///61360", "https://eclass.eu/x", "http://x.iec.ch/1", "https://admin-shell.io/x", "https://x.org", "foo", ""]
    assert column(spark, ids, semantics.dictionary) == ["ECLASS", "IEC_CDD", "ECLASS", "IEC_CDD", "IDTA", "IRI", "custom", "unknown"]
    assert column(spark, ["0173-1#02-AAO677#002", "a#b", "x"], semantics.version) == ["002", "1.0", "1.0"]


def test_type_codes_and_values(spark):
    assert column(spark, ["xs:unsignedInt", "XS:INT", "xs:nope"], types.xsd_code) == [7, 3, 12]
    assert column(spark, ["null", "true", "5", "3000000000", "1.5", '"x"'], types.infer_code) == [0, 11, 3, 4, 10, 12]
    assert column(spark, ["xs:integer", "xs:Double", None, "xs:anyURI"], types.xsd_name) == ["xs:int", "xs:double", "xs:string", "xs:anyURI"]
    df = spark.createDataFrame([("xs:int", "042"), ("xs:boolean", "1"), ("xs:string", 'a"b'), ("xs:double", "x"), ("xs:int", None)], "t string, l string")
    rows = df.select(types.typed_value(F.col("t"), F.col("l"))["value_json"].alias("j")).collect()
    assert [r.j for r in rows] == ["42", "true", '"a\\"b"', "null", "null"]


def test_entropy_grade_action(spark):
    df = spark.createDataFrame([(5, 5), (10, 1), (8, 4), (0, 0), (1, 0)], "o int, k int")
    got = [r[0] for r in df.select(scoring.entropy_loss(F.col("o"), F.col("k"))).collect()]
    assert got == pytest.approx([0, 1, 1 / 3, 0, 0])
    scores = spark.createDataFrame([(x,) for x in (0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.1)], "s double")
    assert [r[0] for r in scores.select(scoring.grade(F.col("s"))).collect()] == ["A+", "A", "B+", "B", "C", "D", "F"]
    kinds = spark.createDataFrame(
        [("value_anomaly", "critical", 0.2), ("value_anomaly", "critical", 0.9), ("value_anomaly", "high", 0.9), ("value_anomaly", "low", 0.9),
         ("schema_evolution", "high", 0.9), ("schema_evolution", "medium", 0.9), ("concept_drift", "low", 0.9), ("other", "low", 0.9)],
        "t string, s string, c double")
    got = [r[0] for r in kinds.select(scoring.action(F.col("t"), F.col("s"), F.col("c"))).collect()]
    assert got == ["monitor", "quarantine", "alert", "auto_accept", "quarantine", "alert", "alert", "monitor"]


def test_globs_agree_with_the_shell_rule():
    import fnmatch
    import random
    import re

    from plantweave.functions.text import glob_to_regex

    rng = random.Random(0)
    patterns = ["List[]*", "[z-a]", "[!z-a]", "[!]", "[", "a[b", "[]a]", "[a-c]x", "[!a]?"]
    patterns += ["".join(rng.choice("ab[]!-*?z^") for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    for p in patterns:
        regex = re.compile(glob_to_regex(p).replace("\\z", "\\Z"))
        for text in ("a", "b", "", "List[]x", "[", "-", "!", "ab", "[a", "a[b", "z", "^", "ax", "zb]"):
            assert bool(regex.match(text)) == fnmatch.fnmatchcase(text, p), (p, text)
