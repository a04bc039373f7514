import os.path
import random

from pyspark.sql import functions as F

from foliomill.functions import admission, names
from foliomill.functions.text import newlines, strip

# name, stem, ext, suffix, folder rule, form rule, service rule
EDGE = [
    ("a.png", "a", ".png", ".png", True, True, True),
    ("B.JPG", "B", ".JPG", ".JPG", True, True, True),
    (".png", ".png", "", "", True, True, False),
    ("..png", "..png", "", ".png", True, True, True),
    ("a.", "a", ".", "", False, False, False),
    ("a.b.c.webp", "a.b.c", ".webp", ".webp", True, True, True),
    ("noext", "noext", "", "", False, False, False),
    ("png", "png", "", "", False, False, False),
    ("a.png.txt", "a.png", ".txt", ".txt", False, False, False),
]


def test_edge_names(spark):
    n = F.col("n")
    rows = spark.createDataFrame([(x[0],) for x in EDGE], "n string").select(
        "n", names.split_ext(n)["stem"], names.split_ext(n)["ext"], names.path_suffix(n), names.is_page(n), names.has_allowed_ext(n), names.api_ext_ok(n)
    )
    assert [tuple(r) for r in rows.collect()] == EDGE


def test_split_agrees_with_the_platform_on_random_names(spark):
    rng = random.Random(7)
    made = sorted({"".join(rng.choice("ab.. J\n") for _ in range(rng.randint(1, 8))) for _ in range(1500)})
    rows = spark.createDataFrame([(x,) for x in made], "n string").select("n", names.split_ext(F.col("n")).alias("s")).collect()
    assert [(r["s"]["stem"], r["s"]["ext"]) for r in rows] == [os.path.splitext(r["n"]) for r in rows]


def test_output_names(spark):
    n = F.col("n")
    rows = spark.createDataFrame([("x.PNG",), (".png",), ("a",)], "n string").select(
        names.output_name(n, "batch"), names.output_name(n, "api"), names.output_url(n), names.media_type(n), names.output_name(n, "form")
    )
    found = [tuple(r) for r in rows.collect()]
    assert [r[:4] for r in found] == [
        ("x.jpg", "x_translated.png", "/api/outputs/x.PNG", "image/PNG"),
        (".png.jpg", ".png_translated", "/api/outputs/.png", "image/"),
        ("a.jpg", "a_translated", "/api/outputs/a", "image/"),
    ]
    assert len({r[4] for r in found}) == 3 and all(len(r[4]) == 36 for r in found)


def test_sizes_and_first_failure(spark):
    rows = spark.createDataFrame(
        [(True, "a.png", 10485760), (True, "a.png", 10485761), (True, "a.txt", 99999999), (False, "a.txt", 1), (None, None, None)],
        "configured boolean, file_name string, length long",
    )
    found = [(r["admitted"], r["code"], r["reason"]) for r in admission.admit(rows, "api").collect()]
    assert found == [(True, None, None), (False, 413, "size"), (False, 400, "extension"), (False, 400, "not configured"), (False, 400, "not configured")]


def test_keys_and_runs(spark):
    keys = spark.createDataFrame([(" ",), (admission.PLACEHOLDER_KEY,), (" k ",), (None,)], "k string")
    assert [r[0] for r in keys.select(admission.has_key(F.col("k"))).collect()] == [False, False, True, False]
    runs = spark.createDataFrame([(True, "i", True, "o"), (True, "i", False, ""), (True, "", None, "o")], "has_key boolean, input_dir string, input_exists boolean, output_dir string")
    assert [r["error"] for r in admission.validate_runs(runs).collect()] == [None, "input not found", "input missing"]


def test_strip_and_newlines(spark):
    texts = ["  a ", "　b\xa0", "\x1cc\x85", "﻿d", "e​", "\t\n", "", "f g"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(strip(F.col("t"))).collect()] == [t.strip() for t in texts]
    assert spark.range(1).select(newlines(F.lit("a\r\nb\rc\n"))).first()[0] == "a\nb\nc\n"
