"""Indexes, query parsing, ranking by evidence and distance, raw-text search, cards."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import geo, text
from factloom.functions.text import normalize_text
from factloom.operators.bullets import FIELDS, keep_first
from factloom.operators.mapping import CAPABILITIES, DOMAINS

BANDS_KM = [50.0, 150.0, 300.0, 600.0]
LEAST_RESULTS = 5
LIMIT = 20
#: Later entries win over the vocabulary's own.
PHRASE_OVERRIDES = {"surgery": "general_surgery", "emergency surgery": "general_surgery"}


def city_index(facilities: DataFrame, city: str = "address_city", state: str = "address_stateOrRegion", lat: str = "latitude", lon: str = "longitude", norm: Callable[[Column], Column] = text.normalize) -> DataFrame:
    """norm_city, state, lat, lon, count, display_city: of each normalised city the (city, state) with the most facilities, ties to the smaller state."""
    rows = facilities.select(norm(F.col(city)).alias("norm_city"), F.col(state).alias("state"), F.col(city).alias("city"), geo.number(F.col(lat)).alias("lat"), geo.number(F.col(lon)).alias("lon"))
    stats = rows.where("norm_city <> '' and lat is not null and lon is not null").groupBy("norm_city", "state").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("count"), F.mode("city", True).alias("display_city"))
    return stats


def main_city(stats: DataFrame) -> DataFrame:
    """Of each normalised city the state with the most facilities, ties to the smaller state."""
    return keep_first(stats, ["norm_city"], [F.desc("count"), F.col("state").asc_nulls_last()])


def with_mismatch(facilities: DataFrame, stats: DataFrame, norm: Callable[[Column], Column] = text.normalize) -> DataFrame:
    """geo_mismatch_km: distance of a facility to the mean position of its own (city, state); null without either. A null state matches none."""
    lat, lon = geo.number(F.col("latitude")), geo.number(F.col("longitude"))
    centres = stats.select(F.col("norm_city").alias("factloom_city"), F.col("state").alias("factloom_state"), F.col("lat").alias("factloom_lat"), F.col("lon").alias("factloom_lon"))
    keyed = facilities.withColumn("factloom_norm", norm(F.col("address_city")))
    both = keyed.join(centres, (F.col("factloom_norm") == F.col("factloom_city")) & (F.col("address_stateOrRegion") == F.col("factloom_state")), "left")
    return both.withColumn("geo_mismatch_km", geo.haversine(lat, lon, F.col("factloom_lat"), F.col("factloom_lon"))).select(*facilities.columns, "geo_mismatch_km")


#: Sizes of grid cells in degrees. The last has three by two cells, of which any place and its neighbours are all.
CELLS = [0.5, 2.0, 8.0, 120.0]


def nearest_city(facilities: DataFrame, stats: DataFrame, key: str = "unique_id") -> DataFrame:
    """key, nearest_label, nearest_km for facilities far from their own city: the closest centre.

    Facilities meet the centres of their grid cell and its neighbours. A centre nearer than anything beyond these can be is the closest; the others go on to larger cells.
    """
    lat, lon = geo.number(F.col("latitude")), geo.number(F.col("longitude"))
    left = facilities.where(F.col("geo_mismatch_km") >= geo.MISMATCH_KM).select(key, lat.alias("f_lat"), lon.alias("f_lon")).where("f_lat is not null and f_lon is not null").distinct()
    centres = stats.select(F.concat_ws(", ", "display_city", "state").alias("label"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    found = None
    for size in CELLS:
        across = round(360 / size)
        row = lambda c: F.floor((F.col(c) + 90) / size)
        column = lambda c: F.pmod(F.floor((F.col(c) + 180) / size), F.lit(across))
        cells = centres.withColumn("row", row("c_lat")).withColumn("column", column("c_lon"))
        steps = F.sequence(F.lit(-1), F.lit(1))
        around = left.withColumn("row", F.explode(F.transform(steps, lambda d: row("f_lat") + d))).withColumn("column", F.explode(F.array_distinct(F.transform(steps, lambda d: F.pmod(column("f_lon") + d, F.lit(across))))))
        pairs = around.join(cells, ["row", "column"]).withColumn("km", geo.haversine(F.col("f_lat"), F.col("f_lon"), F.col("c_lat"), F.col("c_lon")))
        best = pairs.groupBy(key, "f_lat", "f_lon").agg(F.min_by("label", F.struct("km", "label")).alias("nearest_label"), F.min("km").alias("nearest_km"))
        if size != CELLS[-1]:
            # a place that differs by a cell in latitude, or by one in longitude within that latitude
            edge = F.least(F.lit(90.0), F.abs("f_lat") + size)
            reach = F.least(F.lit(size), F.degrees(2 * F.asin(F.cos(F.radians(edge)) * F.sin(F.radians(F.lit(size / 2)))))) * (geo.EARTH_RADIUS_KM * 3.141592653589793 / 180)
            best = best.where(F.col("nearest_km") <= reach)
            left = left.join(best.select(key, "f_lat", "f_lon"), [key, "f_lat", "f_lon"], "left_anti")
        found = best if found is None else found.unionByName(best)
    return found.groupBy(key).agg(F.min_by("nearest_label", F.struct("nearest_km", "nearest_label")).alias("nearest_label"), F.min("nearest_km").alias("nearest_km"))


def adaptive_band(rows: DataFrame, counts: Column, bands: list[float] | None = None, least: int = LEAST_RESULTS) -> DataFrame:
    """The rows within the first band that has enough rows with `counts`, else all; with search_band_km (null: all) and search_widened."""
    bands = bands or BANDS_KM
    chosen = F.lit(None).cast("double")
    for b in reversed(bands):
        chosen = F.when(F.count_if(counts & (F.col("distance_km") <= b)) >= least, F.lit(b)).otherwise(chosen)
    one = rows.agg(chosen.alias("search_band_km"))
    widened = F.col("search_band_km").isNull() | (F.col("search_band_km") != bands[0])
    return rows.crossJoin(F.broadcast(one)).where("search_band_km is null or distance_km <= search_band_km").withColumn("search_widened", widened)  # one row


def rank_candidates(readiness: DataFrame, facilities: DataFrame, capability: str, lat: float, lon: float, mode: str = "best", limit: int = LIMIT, once: bool = True) -> DataFrame:
    """Facilities for one capability: those with evidence within the band in the order of the mode, then the others by distance.

    once: a facility that is listed twice is ranked once (its smallest row), else as often as it is listed.
    """
    columns = {"facility_id": F.col("unique_id").cast("string"), "name": F.col("name"), "lat": geo.number(F.col("latitude")), "lon": geo.number(F.col("longitude"))}
    for c in ("facilityTypeId", "geo_mismatch_km", "address_city", "address_stateOrRegion"):
        columns[c] = F.col(c) if c in facilities.columns else F.lit(None)
    places = facilities.select(*[v.alias(k) for k, v in columns.items()])
    if once:
        places = keep_first(places, ["facility_id"], ["name", "lat", "lon"])
    rows = readiness.where(F.col("capability_id") == capability).join(places, "facility_id").where("lat is not null and lon is not null")
    score = F.col("readiness_score") if "readiness_score" in readiness.columns else F.lit(0.0)
    rows = rows.withColumn("distance_km", geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")))
    rows = rows.withColumn("verdict_rank", geo.by_verdict(F.col("verdict"), geo.VERDICT_RANK, 3)).withColumn("evidence_score", geo.evidence(F.col("verdict"), score))
    rows = rows.withColumn("proximity_score", geo.proximity(F.col("distance_km"), geo.number(F.col("geo_mismatch_km"))))
    rows = rows.withColumn("composite_score", geo.composite(F.col("evidence_score"), F.col("proximity_score"), F.col("facilityTypeId")))
    rows = rows.withColumn("is_evidence_tier", F.col("distinct_tracer_count") > 0)
    banded = adaptive_band(rows, F.col("is_evidence_tier"))
    # the rows without evidence are always by distance, so the mode's keys are null for them
    keys = [F.when(F.col("is_evidence_tier"), F.col(c)) for c in ("composite_score", "verdict_rank", "distinct_tracer_count")]
    named = banded.withColumn("k_composite", keys[0]).withColumn("k_verdict", keys[1]).withColumn("k_tracers", keys[2])
    order = {"best": [F.desc("k_composite")], "most_evidence": [F.asc("k_verdict"), F.desc("k_tracers")]}.get(mode, [])
    return named.orderBy(F.desc("is_evidence_tier"), *order, F.asc("distance_km"), F.asc("facility_id")).limit(limit).drop("k_composite", "k_verdict", "k_tracers")


def search_raw(bullets: DataFrame, facilities: DataFrame, terms: list[str], lat: float, lon: float, mode: str = "best", limit: int = LIMIT) -> DataFrame:
    """Facilities with bullets that hold all terms as whole words: their number, the first five, and a score of number and distance.

    Of a facility's bullets with the same text, as written, the first counts. Order: field, position (where the bullets have one), id.
    """
    hits = bullets
    for term in terms:
        hits = hits.where(F.col("text_norm").rlike(r"\b\Q" + term + r"\E\b"))
    if not terms:
        hits = hits.where("false")
    field = F.array_position(F.array(*[F.lit(f) for f in FIELDS]), F.col("source_field"))
    order = [F.when(field == 0, len(FIELDS) + 1).otherwise(field), *(["position"] if "position" in bullets.columns else []), "bullet_id"]
    hits = keep_first(hits, ["facility_id", "text"], order)
    rank = F.row_number().over(Window.partitionBy("facility_id").orderBy(*order))
    firsts = F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "bullet_id", "source_field", "text"))))
    items = hits.withColumn("r", rank).groupBy("facility_id").agg(F.count("*").alias("raw_match_count"), F.transform(firsts, lambda x: x.dropFields("r")).alias("items"))
    places = keep_first(facilities.select(F.col("unique_id").cast("string").alias("facility_id"), "name", geo.number(F.col("latitude")).alias("lat"), geo.number(F.col("longitude")).alias("lon")), ["facility_id"], ["name"])
    rows = items.join(places, "facility_id").where("lat is not null and lon is not null")
    rows = rows.withColumn("distance_km", geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")))
    banded = adaptive_band(rows, F.lit(True))
    top = banded.agg(F.greatest(F.lit(1), F.max("raw_match_count")).alias("factloom_top"))
    scored = banded.crossJoin(F.broadcast(top)).withColumn("match_score", F.log1p("raw_match_count") / F.log1p("factloom_top")).drop("factloom_top")  # one row
    scored = scored.withColumn("composite_score", 0.6 * F.col("match_score") + 0.4 * geo.proximity(F.col("distance_km")))
    order = {"most_evidence": [F.desc("raw_match_count")], "nearest": []}.get(mode, [F.desc("composite_score")])
    return scored.orderBy(*order, F.asc("distance_km"), F.asc("facility_id")).limit(limit)


def cards(ranked: DataFrame, mapped: DataFrame, bullets: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """A card for each ranked pair: evidence by domain with the quote marked in its text, rejected items, gaps, contradictions."""
    domains = domains or DOMAINS
    rows = mapped.join(bullets.select("bullet_id", F.col("text").alias("full_text")), "bullet_id", "left")
    whole = F.coalesce("full_text", "supporting_quote")
    item = F.struct("bullet_id", "tracer_id", "source_field", "provenance_status", text.highlight(whole, F.col("supporting_quote")).alias("passage"))
    per_domain = rows.groupBy("facility_id", "capability_id", "domain").agg(
        F.array_sort(F.collect_list(F.when(~F.col("exclude_from_scoring"), item))).alias("accepted"), F.array_sort(F.collect_list(F.when(F.col("exclude_from_scoring"), item))).alias("rejected")
    )
    place = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain"))
    order = F.when(place == 0, len(domains) + 1).otherwise(place)
    evidence = per_domain.groupBy("facility_id", "capability_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("ord"), "domain", "accepted", "rejected"))).alias("evidence"))
    gaps = F.array_sort(F.map_keys(F.map_filter("domain_scores", lambda d, s: s == 0)))
    return ranked.withColumn("label", text.verdict_label(F.col("verdict"))).withColumn("gaps", gaps).join(evidence, ["facility_id", "capability_id"], "left")


# --- query parsing: a few words against small indexes, on the driver ---


@dataclass(frozen=True)
class ParsedQuery:
    raw_text: str
    capability_id: str | None = None
    capability_phrase: str | None = None
    city_label: str | None = None
    origin_lat: float | None = None
    origin_lon: float | None = None
    city_facility_count: int | None = None
    used_llm_fallback: bool = False
    llm_error: str | None = None


def capability_index(vocabulary: dict) -> dict[str, str]:
    """Normalised phrase → capability: each capability's own words, its synonyms, then the overrides."""
    out = {}
    for capability, phrases in vocabulary.items():
        if capability in CAPABILITIES:
            out |= {n: capability for n in map(normalize_text, [capability.replace("_", " "), *phrases]) if n}
    return out | PHRASE_OVERRIDES


def best_phrase_in(query: str, phrases: dict) -> str | None:
    """The longest phrase that stands in the query word by word; of equally long ones the first."""
    padded = f" {normalize_text(query)} "
    found = [(-len(p), padded.index(f" {p} "), p) for p in phrases if f" {p} " in padded]
    return min(found)[2] if found else None


def parse_query(query: str, capabilities: dict[str, str], cities: dict[str, tuple], helper: Callable[[str], dict] | None = None) -> ParsedQuery:
    """cities: normalised city → (label, lat, lon, count). helper: fills what words alone don't tell ({"capability_id", "city"}); its failure leaves the plain result and is noted."""
    phrase, city = best_phrase_in(query, capabilities), best_phrase_in(query, cities)
    label, lat, lon, count = cities[city] if city else (None, None, None, None)
    parsed = ParsedQuery(query, capabilities.get(phrase), phrase, label, lat, lon, count)
    if helper is None or (parsed.capability_id and parsed.city_label):
        return parsed
    try:
        said = helper(query)
        gained = {}
        if not parsed.capability_id and said.get("capability_id") in CAPABILITIES:
            gained["capability_id"] = said["capability_id"]
        if not parsed.city_label and (place := best_phrase_in(said.get("city") or "", cities)):
            gained |= dict(zip(("city_label", "origin_lat", "origin_lon", "city_facility_count"), cities[place]))
        return replace(parsed, used_llm_fallback=bool(gained), **gained)
    except Exception as e:  # the helper is the caller's; any failure of it must not lose the plain result
        return replace(parsed, llm_error=f"{type(e).__name__}: {e}"[:200])
