import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import mapping, phrases, provenance, readiness, review, search
from factloom.operators.bullets import explode_bullets
from factloom.sources import tables

FACILITY = "unique_id string, name string, address_city string, address_stateOrRegion string, latitude double, longitude double, capability string, procedure string, equipment string"


def facilities(spark, rows):
    return spark.createDataFrame(rows, FACILITY)


def test_explode_bullets_numbers_after_filtering(spark):
    f = facilities(spark, [("f1", "A", "Pune", "MH", 18.5, 73.9, json.dumps(["", 3, None, " x ", "y"]), "nope", None)])
    rows = sorted(explode_bullets(f).collect(), key=lambda r: r.position)
    assert [(r.source_field, r.position, r.text, r.text_norm) for r in rows] == [("capability", 0, "x", "x"), ("capability", 1, "y", "y")]
    assert explode_bullets(f.limit(0)).count() == 0


def test_phrases_longest_and_best(spark):
    t = spark.createDataFrame([(1, "icu near new delhi new"), (2, ""), (3, None)], "id int, text_norm string")
    p = spark.createDataFrame([("new delhi",), ("delhi",), ("new",), ("icu",)], "phrase string")
    hits = phrases.find_phrases(t, p, "id")
    assert {(r.phrase, r.start, r.end) for r in hits.collect()} == {("icu", 0, 3), ("new", 9, 12), ("new delhi", 9, 18), ("delhi", 13, 18), ("new", 19, 22)}
    assert {(r.phrase, r.start) for r in phrases.longest_spans(hits, "id").collect()} == {("icu", 0), ("new delhi", 9), ("new", 19)}
    assert [r.phrase for r in phrases.best_phrase(hits, "id").collect()] == ["new delhi"]


RULES = mapping.rules_of(
    {
        "capabilities": {
            "icu": {"domains": {"staff": [{"tracer_id": "icu_service", "include_patterns": [r"\bicu\b", r"intensive care"], "exclude_patterns": [r"\bmobile icu\b"]}], "equipment": [{"tracer_id": "ventilator", "include_patterns": [r"\bventilators?\b"], "source_fields": ["equipment"]}]}},
            "dialysis": {"domains": {"equipment": [{"tracer_id": "machine", "include_patterns": ["dialysis"], "context_patterns": ["machine"]}]}},
        }
    },
    ["icu", "dialysis"],
)


@pytest.mark.parametrize(
    "t, want",
    [
        ("Has ICU with ventilators", {("icu_service", "ICU"), ("ventilator", "ventilators")}),
        ("no ICU here", set()),
        ("no ICU; intensive care unit nearby is another matter altogether, far away from all that we said of icu before: intensive care", set()),
        ("mobile ICU", set()),
        ("dialysis", set()),
        ("3 dialysis machines", {("machine", "dialysis")}),
        ("😀😀 ICU", {("icu_service", "ICU")}),
        ("éICU", set()),
    ],
)
def test_rule_guards(spark, t, want):
    got = mapping.match_texts(spark.createDataFrame([(t,)], "text string"), RULES)
    assert {(r.tracer_id, r.supporting_quote) for r in got.collect()} == want


def test_taxonomy_errors():
    with pytest.raises(ValueError):
        mapping.rules_of({"icu": {}}, ["icu", "dialysis"])
    with pytest.raises(ValueError):
        mapping.rules_of({"icu": {"kitchen": []}}, ["icu"])
    with pytest.raises(ValueError):
        mapping.rules_of({"icu": {"staff": [{"tracer_id": "a", "include_patterns": []}]}}, ["icu"])


def test_map_and_readiness(spark):
    bullets = spark.createDataFrame([("b1", "f1", "capability", "ICU"), ("b2", "f1", "equipment", "ventilator"), ("b3", "f1", "procedure", "ventilator"), ("b4", "f2", "capability", "ICU")] + [(f"x{i}", "f1", "capability", "other") for i in range(3)], "bullet_id string, facility_id string, source_field string, text string")
    flags = bullets.select("bullet_id", F.lit("consistent_or_no_conflict").alias("status"), (F.col("bullet_id") == "b4").alias("exclude_from_scoring"))
    mapped = mapping.capability_map(bullets, mapping.match_texts(bullets, RULES), flags)
    assert {(r.bullet_id, r.tracer_id) for r in mapped.collect()} == {("b1", "icu_service"), ("b2", "ventilator"), ("b4", "icu_service")}
    assert tuple(mapping.verify_map(mapped, bullets, flags).first()) == (3, 0, 0, 0, 0)
    with pytest.raises(Exception, match="no provenance flag"):
        mapping.capability_map(bullets, mapping.match_texts(bullets, RULES), flags.where("bullet_id <> 'b1'")).collect()
    counts = bullets.groupBy("facility_id").agg(F.count("*").alias("n_bullets"))
    rows = readiness.readiness(mapped, spark.createDataFrame([("f1",), ("f2",), ("f3",)], "facility_id string"), mapping.domain_totals(spark, RULES), counts).collect()
    got = {(r.facility_id, r.capability_id): r for r in rows}
    assert len(got) == 6
    assert got["f1", "icu"].verdict == "corroborated" and got["f1", "icu"].readiness_score == 1.0 and got["f1", "icu"].contradiction_flags == []
    assert got["f2", "icu"].verdict == "insufficient_evidence" and got["f2", "icu"].rejected_bullet_ids == ["b4"]
    assert got["f3", "dialysis"].domain_scores == {"equipment": 0.0}
    claims = mapped.where("tracer_id = 'icu_service' and facility_id = 'f1'")
    row = readiness.readiness(claims, spark.createDataFrame([("f1",)], "facility_id string"), mapping.domain_totals(spark, RULES), counts).where("capability_id = 'icu'").first()
    assert row.contradiction_flags == ["icu claimed with no ventilator evidence"] and row.verdict == "claimed_only" and row.domain_scores == {"equipment": 0.0, "staff": 1.0}


def test_audit_reasons(spark):
    f = facilities(
        spark,
        [
            ("f1", "Sunrise Dialysis Pvt Ltd", "Jaipur", "RJ", 26.9, 75.8, json.dumps(["Clinic located in Mumbai", "clinic branch located in Mumbai", "Mumbai is big"]), json.dumps(["Apollo Kidney provides dialysis", "City Hospital offers care", "city hospital offers care", "Sunrise Dialysis Pvt Ltd offers care"]), None),
            ("f2", "Apollo Kidney", "Mumbai", "MH", 19.0, 72.8, None, None, None),
            ("f3", "City Hospital", "Delhi", "DL", 28.6, 77.2, None, None, None),
        ],
    )
    places, aliases = provenance.city_gazetteer(f)
    bullets = explode_bullets(f)
    got = {r.text: r for r in bullets.join(provenance.audit_bullets(bullets, places, aliases, provenance.org_index(f)).drop("facility_id"), "bullet_id").collect()}
    assert got["Clinic located in Mumbai"].reason_codes == ["explicit_distant_location"] and got["Clinic located in Mumbai"].exclude_from_scoring
    assert got["clinic branch located in Mumbai"].reason_codes == ["possible_branch_location"] and got["clinic branch located in Mumbai"].status == "review"
    assert got["Mumbai is big"].reason_codes == [] and got["Mumbai is big"].matched_places[0].mention == "mumbai"
    assert got["Apollo Kidney provides dialysis"].reason_codes == ["foreign_org_owns_claim"]
    assert got["City Hospital offers care"].reason_codes == ["title_cased_foreign_org_owns_claim"]
    assert got["city hospital offers care"].reason_codes == ["generic_foreign_org_needs_review"]
    assert got["Sunrise Dialysis Pvt Ltd offers care"].status == "consistent_or_no_conflict"
    summary = {r.facility_id: r for r in provenance.facility_summary(f, provenance.audit_bullets(bullets, places, aliases, provenance.org_index(f))).collect()}
    assert summary["f1"].suspected_conflict_bullets == 3 and summary["f2"].total_bullets == 0 and not summary["f2"].has_provenance_conflict


def test_duplicates_upgrade(spark):
    long = "Apollo Kidney provides a very long and detailed claim text that goes on for well over eighty characters in all"
    f = facilities(spark, [("f1", "Sunrise", "Jaipur", "RJ", 26.9, 75.8, json.dumps([long]), None, None), ("f2", "Apollo Kidney", "Mumbai", "MH", 19.0, 72.8, json.dumps([long]), None, None)])
    places, aliases = provenance.city_gazetteer(f)
    bullets = explode_bullets(f)
    got = {r.facility_id: r for r in provenance.audit_bullets(bullets, places, aliases, provenance.org_index(f)).collect()}
    assert got["f1"].reason_codes == ["detailed_duplicate_reinforces_conflict", "foreign_org_owns_claim"]
    assert got["f2"].reason_codes == ["detailed_cross_facility_duplicate"] and got["f2"].duplicate_facility_ids == ["f1", "f2"]


def ranked(spark, near=6, mode="best"):
    rows = [(f"n{i}", "x", "C", "S", 26.9 + i / 100, 75.8) for i in range(near)] + [("far", "x", "D", "S", 13.0, 77.6), ("lost", "x", "D", "S", None, None), ("zero", "x", "C", "S", 26.9, 75.8)]
    f = spark.createDataFrame(rows, "unique_id string, name string, address_city string, address_stateOrRegion string, latitude double, longitude double")
    r = f.select(F.col("unique_id").alias("facility_id"), F.lit("icu").alias("capability_id"), F.when(F.col("unique_id") == "zero", "insufficient_evidence").otherwise("claimed_only").alias("verdict"), F.when(F.col("unique_id") == "zero", 0).otherwise(1).alias("distinct_tracer_count"), F.lit(0.5).alias("readiness_score"))
    return search.rank_candidates(r, f, "icu", 26.9, 75.8, mode).collect()


@pytest.mark.parametrize("mode", ["best", "most_evidence", "nearest"])
def test_bands_and_tiers(spark, mode):
    rows = ranked(spark, mode=mode)
    assert [r.facility_id for r in rows] == [f"n{i}" for i in range(6)] + ["zero"] and not rows[0].search_widened and rows[0].search_band_km == 50
    rows = ranked(spark, near=2, mode=mode)
    assert [r.facility_id for r in rows] == ["n0", "n1", "far", "zero"] and rows[0].search_widened and rows[0].search_band_km is None


def test_parse_query():
    caps = search.capability_index({"icu": ["intensive care unit", "critical care"], "dialysis": ["hemodialysis"], "_note": ["x"]})
    cities = {"jaipur": ("Jaipur, RJ", 26.9, 75.8, 3), "new delhi": ("New Delhi", 28.6, 77.2, 9), "delhi": ("Delhi", 28.7, 77.1, 2)}
    got = search.parse_query("Need critical care near New Delhi", caps, cities)
    assert (got.capability_id, got.city_label, got.city_facility_count) == ("icu", "New Delhi", 9)
    assert search.parse_query("surgery", caps, cities).capability_id == "general_surgery"
    got = search.parse_query("kidney help in Jaipur", caps, cities, lambda q: {"capability_id": "dialysis", "city": "Delhi"})
    assert (got.capability_id, got.city_label, got.used_llm_fallback) == ("dialysis", "Jaipur, RJ", True)
    got = search.parse_query("kidney", caps, cities, lambda q: 1 / 0)
    assert got.capability_id is None and got.llm_error.startswith("ZeroDivisionError")


def test_mismatch_and_nearest(spark):
    f = spark.createDataFrame([("a", "C", "S", 10.0, 70.0), ("b", "C", "S", 10.0, 70.0), ("c", "C", "S", 20.0, 70.0), ("d", "D", "S", 20.0, 70.1), ("e", "C", None, 10.0, 70.0), ("f", "D", "S", None, None)], "unique_id string, address_city string, address_stateOrRegion string, latitude double, longitude double")
    stats = search.city_index(f)
    got = search.with_mismatch(f, stats)
    km = {r.unique_id: r.geo_mismatch_km for r in got.collect()}
    assert km["c"] > 700 and km["d"] == 0 and km["e"] is None and km["f"] is None
    near = {r.unique_id: r.nearest_label for r in search.nearest_city(got, stats).collect()}
    assert near["c"] == "D, S"


def test_cards(spark):
    mapped = spark.createDataFrame([("f", "icu", "staff", "t1", "b1", "capability", "ICU", False, "ok"), ("f", "icu", "other", "t2", "b2", "capability", "bed", True, "review")], "facility_id string, capability_id string, domain string, tracer_id string, bullet_id string, source_field string, supporting_quote string, exclude_from_scoring boolean, provenance_status string")
    ranked = spark.createDataFrame([("f", "icu", "corroborated", {"staff": 1.0, "equipment": 0.0})], "facility_id string, capability_id string, verdict string, domain_scores map<string,double>")
    card = search.cards(ranked, mapped, spark.createDataFrame([("b1", "An icu bed")], "bullet_id string, text string")).first()
    assert card.gaps == ["equipment"] and [e.domain for e in card.evidence] == ["staff", "other"] and card.evidence[0].accepted[0].passage.match == "icu" and len(card.evidence[1].rejected) == 1


def test_shortlist(spark, tmp_path):
    path = str(tmp_path / "shortlist")
    save = lambda user, at: review.save_shortlist(spark, path, user, "f", "icu", {"b": 1, "a": 2}, "corroborated", 1.5, at)
    assert save(" Ann  Lee ", "2024-01-01") and not save("Ann Lee", "2024-01-02") and save("Bob", "2024-01-03")
    assert [r.query_context for r in review.read_shortlist(spark, path, "ann lee").collect()] == ['{"a":2,"b":1}']
    with pytest.raises(ValueError):
        save("  ", "2024-01-04")


def test_corroboration(spark):
    f = spark.createDataFrame(
        [("f1", "Sun Care", "Pune", "MH", "https://sun.example", '["sun.example/a", "facebook.com/sun", 0, null]', "https://sun.example"), ("f2", "Moon", None, "nan", None, None, "plain"), ("f3", "Star", "Goa", "GA", "", "[]", None)],
        "unique_id string, name string, address_city string, address_stateOrRegion string, officialWebsite string, websites string, source_urls string",
    )
    pairs = spark.createDataFrame([("f1", "blood_bank"), ("f2", "icu"), ("f3", "icu")], "facility_id string, capability_id string")
    asked = review.prepare_corroboration(pairs, f)
    by = {r.facility_id: r for r in asked.collect()}
    assert [(x.url, x.source_tier) for x in by["f1"].sources] == [("https://sun.example", "A_official_facility"), ("https://sun.example/a", "A_official_facility"), ("https://facebook.com/sun", "D_directory_or_social")]
    assert by["f1"].query == '"Sun Care" Pune MH blood bank official' and by["f2"].query == '"Moon" icu official' and by["f2"].known_source_count == 0

    def find(query):
        if "Moon" in query:
            raise OSError("down")
        return [{"url": "https://x.gov.in", "content": "we have 10 beds", "source_tier": "A_government_or_registry"}, {"url": "https://sun.example", "content": "later entry"}]

    def extract(row, sources):
        assert [s["source_tier"] for s in sources] == sorted(s["source_tier"] for s in sources)
        quote = "10 beds" if row["facility_id"] == "f1" else "invented"
        return {"status": "corroborated", "exact_quote": quote, "source_url": "https://x.gov.in", "source_tier": "A_government_or_registry", "reason": "r", "facility_identity_match": True}

    rows = review.corroborate(asked, None, find, extract).cache()
    got = {r.facility_id: r for r in rows.collect()}
    assert (got["f1"].status, got["f1"].exact_quote, got["f1"].known_source_count, got["f1"].fresh) == ("corroborated", "10 beds", 4, True)
    assert (got["f2"].status, got["f2"].reason) == ("unverified", "failed safely: OSError")
    assert (got["f3"].status, got["f3"].exact_quote, got["f3"].facility_identity_match) == ("unverified", "", None)
    again = {r.facility_id: r for r in review.corroborate(asked, rows.where("facility_id <> 'f3'"), find, extract).collect()}
    assert [again[k].fresh for k in ("f1", "f2", "f3")] == [False, False, True] and again["f1"].exact_quote == "10 beds"
    assert all(r.fresh for r in review.corroborate(asked, rows, find, extract, refresh=True).collect())
    dry = review.corroborate(asked, None, None, None)
    assert {(r.status, r.fresh) for r in dry.collect()} == {("dry_run", False)}
    one = review.corroboration_summary(rows, pairs).first()
    assert (one.pairs_available, one.pairs_selected, one.fresh_pairs, one.status_counts) == (3, 3, 3, {"corroborated": 1, "unverified": 2})


def test_archived_answers(spark):
    rules = mapping.rule_table(spark, RULES)
    match = lambda tracer, quote: {"capability_id": "icu", "domain": "staff", "tracer_id": tracer, "supporting_quote": quote}
    said = {"0": [match("icu_service", "ICU"), match("nope", "ICU"), match("icu_service", "absent"), match("icu_service", "")], "1": None, "7": [match("icu_service", "bed")], "x": []}
    rows = [(1, ["an ICU", "two"], "Sure: " + json.dumps(said) + " done"), (2, ["two"], "no answer"), (3, ["old"], json.dumps({"0": [match("icu_service", "old")]})), (4, ["old"], json.dumps({"0": []}))]
    found = review.validated_answers(spark.createDataFrame(rows, "batch_id int, batch array<string>, raw string"), rules)
    assert [tuple(r) for r in found.collect()] == [("an ICU", "icu", "staff", "icu_service", "ICU")]
    bullets = spark.createDataFrame([("b1", "f", "capability", "an ICU"), ("b2", "f", "capability", "an ICU"), ("b3", "f", "capability", "two")], "bullet_id string, facility_id string, source_field string, text string")
    flags = spark.createDataFrame([("b1", "review", False)], "bullet_id string, status string, exclude_from_scoring boolean")
    got = review.answers_to_bullets(found, bullets, flags, "m")
    assert sorted((r.bullet_id, str(r.provenance_status), r.llm_model) for r in got.collect()) == [("b1", "review", "m"), ("b2", "None", "m")]


def test_preflight(spark):
    f = facilities(spark, [("f1", "Sun Care", "Pune", "MH", 1.0, 1.0, None, None, None), ("f2", "Moon Lab", "Goa", "GA", 1.0, 1.0, None, None, None)])
    bullets = spark.createDataFrame([("b1", "f1", "Visit Moon Lab, Goa!"), ("b2", "f1", "sun care in pune"), ("b3", "f2", "goals")], "bullet_id string, facility_id string, text string")
    got = {r.facility_id: r for r in review.contamination_scan(bullets, f).collect()}
    assert got["f1"].cities == ["goa"] and got["f1"].orgs == ["moon lab"] and got["f1"].strong and "f2" not in got
    s = spark.createDataFrame([('["a","b"]',), (None,), ('["a","a"]',)], "s string")
    assert [(r.bucket, r.n, r.pct) for r in review.source_histogram(s, "s").collect()] == [("1", 2, 66.7), ("2-4", 1, 33.3), ("5+", 0, 0.0)]
    pairs = spark.createDataFrame([(1, ["a", "b"], ["x"]), (2, [], ["x"])], "id int, l array<string>, r array<string>")
    assert [tuple(r)[1:] for r in review.aligned(pairs, "id", "l", "r").orderBy("position").collect()] == [(0, "a", "x"), (1, "b", None)]


def test_phrases_of_long_texts_and_chunk_borders(spark, monkeypatch):
    """Against str.find; and a text of 200,000 words."""
    import random

    rng = random.Random(1)
    texts = [" ".join(rng.choice("a b ab c".split()) for _ in range(n)) for n in (0, 1, 5, 63, 64, 65, 130, 300)] + ["a  b", " a b "]
    vocabulary = ["a", "a b", "b a b", "a a", "ab c a b", "x"]
    t, p = spark.createDataFrame(list(enumerate(texts)), "id int, text_norm string"), spark.createDataFrame([(x,) for x in vocabulary], "phrase string")
    want = {(i, x, k, k + len(x)) for i, s in enumerate(texts) for x in vocabulary for k in range(len(s)) if f" {s} "[k : k + len(x) + 2] == f" {x} "}
    for chunk in (64, 3):
        monkeypatch.setattr(phrases, "CHUNK", chunk)
        assert {tuple(r) for r in phrases.find_phrases(t, p, "id").collect()} == want
    monkeypatch.undo()
    long = spark.range(1).selectExpr("id", "concat(repeat('lorem ipsum ', 100000), 'a b') as text_norm")
    assert [(r.phrase, r.start) for r in phrases.find_phrases(long, spark.createDataFrame([("a b",), ("ipsum a b",)], "phrase string"), "id").orderBy("start").collect()] == [("ipsum a b", 1199994), ("a b", 1200000)]


def test_raw_search_counts_texts_as_written(spark):
    b = spark.createDataFrame(
        [("f", "b9", "capability", 0, "Has ICU", "has icu"), ("f", "b1", "equipment", 0, "Has ICU", "has icu"), ("f", "b2", "capability", 1, "has icu!", "has icu"), ("f", "b3", "procedure", 0, "icu x", "icu x"), ("f", "b0", "other", 0, "no", "no")],
        "facility_id string, bullet_id string, source_field string, position int, text string, text_norm string",
    )
    f = spark.createDataFrame([("f", "F", 20.0, 80.0)], "unique_id string, name string, latitude double, longitude double")
    got = search.search_raw(b, f, ["icu"], 20.0, 80.0).first()
    assert got.raw_match_count == 3 and [(x.bullet_id, x.source_field, x.text) for x in got.items] == [("b9", "capability", "Has ICU"), ("b2", "capability", "has icu!"), ("b3", "procedure", "icu x")]


def test_gazetteer_by_each_facility(spark):
    """One name in two states keeps both places; a city without coordinates has its only place; an ambiguous one falls back on its own position."""
    places = spark.createDataFrame([(1, "Aurangabad", 19.9, 75.3), (2, "Aurangabad", 24.8, 84.4), (3, "Solo", 10.0, 70.0), (4, "Twin", 12.0, 72.0), (5, "Twin", 12.1, 72.0), (6, "Unused", 1.0, 1.0)], "geoname_id long, name string, latitude double, longitude double")
    aliases = places.selectExpr("geoname_id", "lower(name) as alias").union(spark.createDataFrame([(1, "sambhajinagar")], "geoname_id long, alias string"))
    f = facilities(spark, [(str(k), "n", city, "s", lat, lon, None, None, None) for k, (city, lat, lon) in enumerate([("Aurangabad", 19.8, 75.2), ("Aurangabad", 24.7, 84.3), ("Solo", None, None), ("Twin", 12.0, 72.1), ("Twin", 12.2, 72.1), ("Zed", 5.0, 5.0), ("Lost", None, None)])])
    got, names = provenance.restrict_gazetteer(places, aliases, f)
    assert {(r.geoname_id, r.name, r.latitude) for r in got.collect()} == {(1, "Aurangabad", 19.9), (2, "Aurangabad", 24.8), (3, "Solo", 10.0), (-1, "twin", 12.1), (-2, "zed", 5.0)}
    assert {(r.geoname_id, r.alias) for r in names.collect()} == {(1, "aurangabad"), (1, "sambhajinagar"), (2, "aurangabad"), (3, "solo"), (-1, "twin"), (-2, "zed")}


def test_nearest_city_against_all_pairs(spark):
    import math
    import random

    rng = random.Random(4)
    spot = lambda: (rng.uniform(-89, 89), rng.uniform(-180, 180))
    centres = [spot() for _ in range(40)] + [(0.1, 179.9), (0.0, -179.8), (89.5, 10.0), (20.0, 70.0), (20.2, 70.1)]
    spots = [spot() for _ in range(120)] + [(0.0, 180.0), (88.9, -170.0), (20.1, 70.0), (-89.9, 0.0)]
    stats = spark.createDataFrame([(f"c{k}", "s", a, b) for k, (a, b) in enumerate(centres)], "display_city string, state string, lat double, lon double")
    f = spark.createDataFrame([(k, a, b, 100.0) for k, (a, b) in enumerate(spots)] + [(999, 1.0, 1.0, 3.0), (998, None, 1.0, 100.0)], "unique_id int, latitude double, longitude double, geo_mismatch_km double")

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    got = {r.unique_id: r for r in search.nearest_city(f, stats).collect()}
    assert set(got) == set(range(len(spots)))
    for k, (a, b) in enumerate(spots):
        assert got[k].nearest_km == pytest.approx(min(km(a, b, c, d) for c, d in centres))


def test_small_sources_and_sinks(spark, tmp_path, monkeypatch):
    import os
    import zipfile

    line = "\t".join(["7", "Půne", "Pune", "Poona,X", "18.5", "73.9", "P", "PPL", "IN", "", "MH", "", "", "", "1", "", "", "", "2020"])
    with zipfile.ZipFile(tmp_path / "IN.zip", "w") as z:
        z.writestr("readme.txt", "not this")
        z.writestr("IN.txt", line + "\n")
    places, aliases = tables.read_geonames(spark, str(tmp_path / "IN.zip"))
    assert [r.name for r in places.collect()] == ["Půne"] and {r.alias for r in aliases.collect()} == {"pune", "poona"}
    (tmp_path / "cache.jsonl").write_text('{"cache_key":"a","v":1,"cached_at_epoch":2.0}\n{"cache_key":"a","v":2,"cached_at_epoch":2.0}\n{"cache_key":"a","v":3,"cached_at_epoch":null}\n{"cache_key":"b","v":4,"cached_at_epoch":null}\n')
    assert sorted(tuple(r)[0:1] + (r.v,) for r in tables.read_latest(spark, str(tmp_path / "cache.jsonl")).collect()) == [("a", 2), ("b", 4)]
    calls = []
    fetch = lambda url: calls.append(url) or b"data"
    for _ in range(2):
        assert open(tables.fetch_once("http://x", str(tmp_path / "d" / "f"), fetch), "rb").read() == b"data"
    assert calls == ["http://x"]
    (tmp_path / ".env").write_text("# c\n\nFACTLOOM_A = 'one'\nFACTLOOM_B=two\nno sign\n")
    monkeypatch.setenv("FACTLOOM_B", "kept")
    monkeypatch.delenv("FACTLOOM_A", raising=False)
    assert tables.read_env(str(tmp_path / ".env")) == {"FACTLOOM_A": "one"} and os.environ["FACTLOOM_B"] == "kept" and tables.read_env(str(tmp_path / "none")) == {}
    monkeypatch.delenv("FACTLOOM_A")
    assert tables.create_table(spark, str(tmp_path / "t"), "a int") and not tables.create_table(spark, str(tmp_path / "t"), "a int") and spark.read.parquet(str(tmp_path / "t")).columns == ["a"]
    tables.write_metrics(spark.createDataFrame([(1, "x")], "n int, s string"), str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"n": 1, "s": "x"}
    tables.append_json(spark.createDataFrame([(1,)], "n int"), str(tmp_path / "j"))
    tables.append_json(spark.createDataFrame([(2,)], "n int"), str(tmp_path / "j"))
    assert sorted(r.n for r in spark.read.json(str(tmp_path / "j")).collect()) == [1, 2]
    (tmp_path / "doc.json").write_text('{"a": 1}')
    assert tables.read_document(str(tmp_path / "doc.json")) == {"a": 1}
    spark.range(3).write.parquet(str(tmp_path / "tab"))
    size = tables.build_bundle(spark, ["m.json", "d/f"], {"tab": (str(tmp_path / "tab"), "id")}, str(tmp_path), str(tmp_path / "bundle"))
    assert size > 0 and (tmp_path / "bundle" / "d" / "f").read_bytes() == b"data" and spark.read.parquet(str(tmp_path / "bundle" / "data" / "tab")).count() == 3
    with pytest.raises(FileNotFoundError):
        tables.build_bundle(spark, ["missing"], {}, str(tmp_path), str(tmp_path / "bundle"))
    assert (tmp_path / "bundle" / "m.json").exists()
    spark.range(2).write.mode("overwrite").saveAsTable("factloom_scan_test")
    assert tables.scan_table(spark, "factloom_scan_test").count() == 2
    spark.sql("drop table factloom_scan_test")


def test_back_references_in_rules(spark):
    rules = [{"ord": 0, "capability_id": "icu", "domain": "staff", "tracer_id": "t", "pattern": r"(\w)\1", "excludes": [], "contexts": [], "source_fields": []}]
    got = mapping.match_texts(spark.createDataFrame([("no aa",), ("see bb",), ("xy",)], "text string"), rules).collect()
    assert {(r.text, r.supporting_quote) for r in got} == {("see bb", "ee")}


def test_sources(spark, tmp_path):
    line = "\t".join(["7", "Půne", "Pune", "Poona,X", "18.5", "73.9", "P", "PPL", "IN", "", "MH", "", "", "", "1", "", "", "", "2020"])
    (tmp_path / "IN.txt").write_text(line + "\nshort\trow\n" + line.replace("\tP\t", "\tH\t") + "\n")
    places, aliases = tables.read_geonames(spark, str(tmp_path / "IN.txt"))
    assert [r.geoname_id for r in places.collect()] == [7] and {r.alias for r in aliases.collect()} == {"pune", "poona"}
    (tmp_path / "cache.jsonl").write_text('{"cache_key":"a","v":1,"cached_at_epoch":1.0}\n{"cache_key":"a","v":2,"cached_at_epoch":2.0}\n')
    assert [r.v for r in tables.read_latest(spark, str(tmp_path / "cache.jsonl")).collect()] == [2]
    (tmp_path / "c.csv").write_text("unique_id,capability\n01,icu\n")
    assert tuple(tables.read_candidates(spark, str(tmp_path / "c.csv")).first()) == ("01", "icu")
    big = spark.range(20000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("t"))
    n = tables.write_capped(big, str(tmp_path / "capped"), "id", 1, cap=400_000)
    assert n > 2 and spark.read.parquet(str(tmp_path / "capped")).count() == 20000
    tables.write_csv(pairs := spark.createDataFrame([(1, ["a"])], "id int, l array<string>"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().l == '["a"]' and pairs.count() == 1
    with pytest.raises(ValueError):
        tables.scan(spark, str(tmp_path / "capped"), ["nope"])


def test_stream_bullets(spark, tmp_path):
    from factloom.streaming.incremental import stream_bullets

    f = facilities(spark, [("f1", "A", "Pune", "MH", 1.0, 1.0, '["ICU"]', None, None)])
    f.write.parquet(str(tmp_path / "in"))
    q = stream_bullets(spark, str(tmp_path / "in"), f.schema, str(tmp_path / "out"), str(tmp_path / "ck"), RULES)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "matches")).count() == 1


def test_one_border_is_shared_only_where_it_may_be():
    assert mapping._alternation([r"\bab|cd\b", r"\bx(?:y|z)", r"\bq[(]a|b[)]", "e"]) == r"\b(?:(?:x(?:y|z)))|(?:\bab|cd\b)|(?:\bq[(]a|b[)])|(?:e)"
    assert mapping._plain(r"\b[0-9]{2,}\b") and not mapping._plain("é") and not mapping._plain(r"\p{L}") and not mapping._plain(r"\u212a")


def test_map_is_one_pass_and_made_once(spark, tmp_path):
    """The map moves no text, sees the rules once for each bullet, and readiness aggregates it once."""
    from factloom.plans import driver, views

    docs = [(i, "the MIT license; naïve Licence\nund 42\n\nnot licensed, released") for i in range(6)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("labels", [(1, 1, 0), (2, 0, 0)], "doc_id long, toxic int, quality int"), ("supplier", [(i, f"s{i}", 0) for i in range(4)], "s_suppkey long, s_name string, s_nationkey long"), ("nation", [(0, "N", 0)], "n_nationkey long, n_name string, n_regionkey long"), ("region", [(0, "R")], "r_regionkey long, r_name string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    sf = str(tmp_path)
    slow = mapping.capability_map(views.bullets(spark, sf).withColumn("text", F.col("text_norm")), driver.matches(spark, sf), views.flags(spark, sf))
    mapped = driver.mapped(spark, sf)
    assert mapped.count() and sorted(map(tuple, mapped.collect())) == sorted(map(tuple, slow.collect()))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode")
    assert scans(mapped) == 1 and scans(driver.readiness_of(spark, sf)) == 2  # the other: numbers of bullets


def test_quantiles_of_any_values_are_those_of_percentile(spark):
    at = (0.0, 0.25, 0.5, 0.9, 1.0)
    for values in ([3.5], [-1e300, -2.0, 0.0, None, 1e-300, 7.25, 7.25, 7.25000000000001, float("inf")], [((i * 7919) % 1000) / 7 - 40 for i in range(1000)], []):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = readiness.quantiles(df, "v", at)
        want = df.agg(*[F.percentile("v", q) for q in at]).first()
        assert all(a == b if b is None else a == pytest.approx(b, rel=1e-12) for a, b in zip(got.first(), want, strict=True)), values
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
