import pytest
from pyspark.sql import functions as F

from factloom.functions import geo, text


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("Café  Münster &amp; Co.", "cafe munster and co"), ("Straße-12", "strasse 12"), (None, ""), ("", ""), ("İstanbul", "istanbul"), ("  A  b ", "a b")])
def test_normalize(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.normalize("t")).first()[0] == want
    if raw is not None and raw.isascii():
        assert df.select(text.normalize_ascii(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("raw, want", [('["a", 1, null, true, " b ", ""]', ["a", "b"]), ("['a']", []), ('["a"] x', []), ("", []), (None, []), ('{"a": 1}', []), ("[]", [])])
def test_json_strings(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.json_strings(F.col("t"))).first()[0] == want


def test_bullet_id_is_sha256(spark):
    import hashlib

    got = spark.range(1).select(text.bullet_id(F.lit("f1"), F.lit("procedure"), F.lit(0), F.lit("Héllo"))).first()[0]
    assert got == hashlib.sha256("f1|procedure|0|Héllo".encode()).hexdigest()


@pytest.mark.parametrize(
    "url, official, tier",
    [
        ("https://www.hosp.in/a", "hosp.in", "A_official_facility"),
        ("https://sub.hosp.in:8080", "http://hosp.in", "C_other_web"),
        ("https://sub.hosp.in", "http://hosp.in", "A_official_facility"),
        ("https://x.gov.in", "", "A_government_or_registry"),
        ("foo.ac.in", None, "B_institutional"),
        ("https://m.facebook.com/x", "", "D_directory_or_social"),
        ("", "", "D"),
    ],
)
def test_source_tier(spark, url, official, tier):
    df = spark.createDataFrame([(url, official)], "u string, o string")
    assert df.select(text.source_tier(F.col("u"), F.col("o"))).first()[0] == tier


def test_need_terms_and_highlight(spark):
    df = spark.createDataFrame([("need dialysis machine near jaipur", "jaipur"), ("near jaipur dialysis", "jaipur")], "q string, c string")
    assert [r[0] for r in df.select(text.need_terms(F.col("q"), F.col("c"))).collect()] == [["dialysis", "machine"], ["dialysis"]]
    df = spark.createDataFrame([("Has ICU beds", "icu"), ("none", "icu"), ("x", "")], "t string, q string")
    assert [tuple(r[0]) for r in df.select(text.highlight(F.col("t"), F.col("q"))).collect()] == [("Has ", "ICU", " beds"), ("none", "", ""), ("x", "", "")]


def test_context_windows(spark):
    df = spark.createDataFrame([("a clinic located in mumbai", 20, "city care clinic provides dialysis")], "t string, s int, o string")
    assert df.select(text.location_context(F.col("t"), F.col("s"))).first()[0]
    assert df.select(text.asserts_ownership(F.col("o"), F.lit(0), F.lit(16))).first()[0]
    assert not df.select(text.asserts_ownership(F.lit("listed city care clinic has"), F.lit(7), F.lit(23))).first()[0]
    assert df.select(text.named_org(F.lit("At City Hospital now"), F.lit("city hospital"))).first()[0]
    assert not df.select(text.named_org(F.lit("the city hospital"), F.lit("city hospital"))).first()[0]


def test_distances_and_scores(spark):
    km = spark.range(1).select(geo.haversine(F.lit(26.9124), F.lit(75.7873), F.lit(28.6139), F.lit(77.209))).first()[0]
    assert abs(km - 235.5) < 5
    row = spark.createDataFrame([("corroborated", 0.5, 30.0, 80.0, "Dentist")], "v string, r double, d double, m double, t string")
    e = row.select(geo.evidence(F.col("v"), F.col("r"))).first()[0]
    p = row.select(geo.proximity(F.col("d"), F.col("m"))).first()[0]
    assert (e, p) == (0.75, 0.25)
    assert row.select(geo.composite(F.lit(e), F.lit(p), F.col("t"))).first()[0] == pytest.approx((0.6 * 0.75 + 0.4 * 0.25) * 0.2)
    assert spark.sql("select 'nan' as x").select(geo.number(F.col("x"))).first()[0] is None


def test_rounding_is_that_of_the_binary_value(spark):
    import random

    rng = random.Random(2)
    values = [2.675, 0.41665, 0.5, 1.5, 2.5, -2.675, 0.0, 1e-9, 0.125, 0.375, 1e17, 0.045, 1.005, None] + [round(rng.uniform(-100, 100), rng.randrange(6)) for _ in range(3000)] + [rng.randrange(2000) / 1000 + 0.0005 for _ in range(2000)] + [rng.random() for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (1, 2, 3, 4):
        got = [r[0] for r in df.select(geo.rounded(F.col("x"), digits)).collect()]
        assert all(a == b for a, b in zip(got, [None if x is None else round(x, digits) for x in values]))


@pytest.mark.parametrize("raw, want", [('["a", 3, 0, null, "", true, false, 1.5, []]', ["a", "3", "True", "1.5"]), ("https://x.org", ["https://x.org"]), ("ftp://x", []), ("", []), (None, []), ('{"a": 1}', []), ("[]", [])])
def test_url_list(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.url_list(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("raw", ["blood_bank", "x-ray_unit", "ICU", "o2 plant", "été_noir", "", "a'b"])
def test_display_name_is_title_case(spark, raw):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.display_name(F.col("t"))).first()[0] == raw.replace("_", " ").title()


def test_item_texts_and_search_queries(spark):
    df = spark.createDataFrame([('["a", 1, null, {"b": 2}]', "N", None, "nan", "blood_bank")], "t string, n string, c string, s string, k string")
    assert df.select(text.item_texts(F.col("t"))).first()[0] == ["a", "1", None, '{"b":2}']
    assert df.select(text.search_query(F.col("n"), F.col("c"), F.col("s"), F.col("k"))).first()[0] == '"N" blood bank official'
    assert df.select(text.user_name(F.lit("  a \t b  ")), text.user_name(F.lit("  "))).first()[:] == ("a b", None)
