"""Does a bullet belong to its facility? Places and organisations it names, and texts that several facilities share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import geo, text
from factloom.operators.bullets import cross_facility_duplicates, keep_first
from factloom.operators.phrases import find_phrases, longest_spans

MARGIN_KM, NEAR_KM, FAR_KM, NEARBY_CHARS = 25.0, 50.0, 75.0, 60


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the place (from 1) of each row in the order of a column of distinct normalised texts.

    Rows are numbered within what begins with the same two characters, of which there are at most 37 x 37; only the numbers of these go to one task.
    """
    starts = df.withColumn("factloom_start", F.left(column, F.lit(2)))
    sizes = starts.groupBy("factloom_start").agg(F.count("*").alias("factloom_n"))
    before = F.coalesce(F.sum("factloom_n").over(Window.orderBy("factloom_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("factloom_start", before.alias("factloom_before"))
    own = F.row_number().over(Window.partitionBy("factloom_start").orderBy(column))
    return starts.withColumn("factloom_own", own).join(F.broadcast(offsets), "factloom_start").withColumn(name, (F.col("factloom_before") + F.col("factloom_own")).cast("long")).select(*df.columns, name)


def _city_rows(facilities: DataFrame) -> DataFrame:
    rows = facilities.select(text.normalize(F.col("address_city").cast("string")).alias("alias"), geo.number(F.col("latitude")).alias("lat"), geo.number(F.col("longitude")).alias("lon"))
    return rows.where(text.valid_alias(F.col("alias")))


def _medians(facilities: DataFrame) -> DataFrame:
    rows = _city_rows(facilities).where(geo.on_earth(F.col("lat"), F.col("lon")))
    return rows.groupBy("alias").agg(F.median("lat").alias("latitude"), F.median("lon").alias("longitude"))


def _own_places(cities: DataFrame) -> tuple[DataFrame, DataFrame]:
    places = numbered(cities, "alias", "factloom_id").select((-F.col("factloom_id")).alias("geoname_id"), F.col("alias").alias("name"), "latitude", "longitude")
    return places, places.select("geoname_id", F.col("name").alias("alias"))


def city_gazetteer(facilities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places and aliases from the facilities themselves: the median position of each city, ids -1, -2 and so on in order of cities."""
    return _own_places(_medians(facilities))


def resolve_places(mentions: DataFrame, places: DataFrame, aliases: DataFrame, keys: list[str], alias: str = "alias", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """keys, alias, geoname_id, name, distance_km, ambiguous: the one place of a name, or the nearest if the next is MARGIN_KM further away."""
    asked = mentions.select(*keys, F.col(alias).alias("alias"), F.col(lat).alias("factloom_lat"), F.col(lon).alias("factloom_lon")).distinct()
    found = asked.join(aliases.select("geoname_id", "alias").distinct(), "alias").join(places.select("geoname_id", "name", "latitude", "longitude"), "geoname_id")
    found = found.withColumn("distance_km", geo.haversine(F.col("factloom_lat"), F.col("factloom_lon"), F.col("latitude"), F.col("longitude")))
    by = Window.partitionBy(*keys, "alias").orderBy(F.col("distance_km").asc_nulls_last(), "geoname_id")
    every = Window.partitionBy(*keys, "alias")
    ranked = found.withColumn("factloom_rank", F.row_number().over(by)).withColumn("factloom_next", F.lead("distance_km").over(by)).withColumn("factloom_n", F.count("*").over(every))
    clear = (F.col("factloom_n") == 1) | (F.col("factloom_next") - F.col("distance_km") >= MARGIN_KM)
    return ranked.where("factloom_rank = 1").select(*keys, "alias", "geoname_id", "name", "distance_km", (~F.coalesce(clear, F.lit(False))).alias("ambiguous"))


def restrict_gazetteer(places: DataFrame, aliases: DataFrame, facilities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The places that facilities mean by their cities, each facility by its own position, so one name may keep places in several states.

    A city that some facility doesn't resolve (no place of the name, or several equally near) means the facilities' own median position and nothing else, if there is one.
    """
    asked = _city_rows(facilities).distinct()
    meant = resolve_places(asked.withColumn("factloom_at", F.struct("lat", "lon")), places, aliases, ["factloom_at"]).where("not ambiguous")
    kept = meant.select("geoname_id").distinct()
    found = meant.select("alias", F.col("factloom_at").alias("at")).distinct()
    same = (asked["alias"] == found["alias"]) & asked["lat"].eqNullSafe(found["at.lat"]) & asked["lon"].eqNullSafe(found["at.lon"])
    unresolved = asked.join(found, same, "left_anti").select("alias").distinct()
    own_places, own_aliases = _own_places(_medians(facilities).join(unresolved, "alias", "left_semi"))
    columns = ["geoname_id", "name", "latitude", "longitude"]
    out = places.join(kept, "geoname_id", "left_semi").select(*columns).unionByName(own_places.select(*columns))
    old = aliases.join(kept, "geoname_id", "left_semi").select("geoname_id", "alias").join(own_aliases.select("alias"), "alias", "left_anti")
    return out, old.select("geoname_id", "alias").unionByName(own_aliases)


def org_index(facilities: DataFrame) -> DataFrame:
    """term, facility_ids, core (distinctive words), generic."""
    names = facilities.select(F.col("unique_id").cast("string").alias("facility_id"), text.normalize(F.col("name").cast("string")).alias("term"))
    names = names.where((F.length("term") >= 4) & (F.size(F.split("term", " ")) <= 18))
    terms = names.groupBy("term").agg(F.array_sort(F.collect_set("facility_id")).alias("facility_ids"))
    return terms.withColumn("core", text.org_core(F.col("term"))).withColumn("generic", text.is_generic_org(F.col("term")))


def audit_bullets(bullets: DataFrame, places: DataFrame, aliases: DataFrame, orgs: DataFrame) -> DataFrame:
    """bullet_id, facility_id, status, exclude_from_scoring, reason_codes, matched_places, matched_organizations, duplicate_facility_ids."""
    own = bullets.select("facility_id", "facility_city", "facility_name", "facility_latitude", "facility_longitude").distinct()
    own = keep_first(own, ["facility_id"], ["facility_name", "facility_city", "facility_latitude", "facility_longitude"])
    own = own.select("facility_id", text.normalize("facility_city").alias("own_city"), text.normalize("facility_name").alias("own_name"), F.col("facility_latitude").alias("lat"), F.col("facility_longitude").alias("lon"))
    own = own.withColumn("own_core", text.org_core(F.col("own_name")))
    home = resolve_places(own.withColumn("alias", F.col("own_city")), places, aliases, ["facility_id"]).where("not ambiguous").select("facility_id", F.col("geoname_id").alias("own_place"))
    own = own.join(home, "facility_id", "left")
    texts = bullets.select("bullet_id", "facility_id", "text", "text_norm")

    spans = longest_spans(find_phrases(texts, aliases, "bullet_id", phrase="alias"), "bullet_id").withColumnRenamed("phrase", "alias")
    spans = spans.join(texts.drop("text"), "bullet_id").join(own, "facility_id").where("alias <> own_city")
    meant = resolve_places(spans, places, aliases, ["facility_id"])
    spans = spans.join(meant, ["facility_id", "alias"])
    t, start, end = F.col("text_norm"), F.col("start"), F.col("end")
    around = F.substring(t, F.greatest(F.lit(0), start - NEARBY_CHARS) + 1, end - start + NEARBY_CHARS + F.least(F.lit(NEARBY_CHARS), start))
    near_own = (F.col("own_city") != "") & around.contains(F.col("own_city"))
    context = text.location_context(t, start)
    at_home = F.coalesce(F.col("geoname_id") == F.col("own_place"), F.lit(False)) | near_own | F.coalesce(F.col("distance_km") <= NEAR_KM, F.lit(False))
    reason = F.when(F.col("ambiguous"), F.when(context, "ambiguous_place_mention")).when(
        ~at_home & context,
        F.when(t.rlike(text.BRANCH_CUES), "possible_branch_location").when(F.col("distance_km") >= FAR_KM, "explicit_distant_location").otherwise("foreign_location_needs_review"),
    )
    place = F.struct(F.col("start").alias("start"), F.col("alias").alias("mention"), F.col("name").alias("canonical"), "geoname_id", geo.rounded(F.col("distance_km"), 1).alias("distance_km"))
    place_facts = spans.withColumn("reason", reason).groupBy("bullet_id").agg(F.collect_set("reason").alias("place_reasons"), F.array_sort(F.collect_list(F.when(~F.col("ambiguous"), place))).alias("matched_places"))

    named = longest_spans(find_phrases(texts, orgs, "bullet_id", phrase="term"), "bullet_id").withColumnRenamed("phrase", "term")
    named = named.join(texts, "bullet_id").join(own.select("facility_id", "own_name", "own_core"), "facility_id").join(orgs.select("term", "core", "generic"), "term")
    shared = F.size(F.array_intersect("own_core", "core")) / F.size(F.array_distinct("core"))
    is_own = F.col("own_name").contains(F.col("term")) | ((F.size("own_core") > 0) & (F.size("core") > 0) & F.coalesce(shared >= 0.8, F.lit(False)))
    named = named.where(~is_own & text.asserts_ownership(t, start, end))
    org_reason = F.when(~F.col("generic"), "foreign_org_owns_claim").when(text.named_org(F.col("text"), F.col("term")), "title_cased_foreign_org_owns_claim").otherwise("generic_foreign_org_needs_review")
    org_facts = named.withColumn("reason", org_reason).groupBy("bullet_id").agg(F.collect_set("reason").alias("org_reasons"), F.array_sort(F.collect_set("term")).alias("matched_organizations"))

    none = F.expr("cast(array() as array<string>)")
    all_facts = texts.join(place_facts, "bullet_id", "left").join(org_facts, "bullet_id", "left").join(cross_facility_duplicates(bullets), "text_norm", "left")
    found = F.array_union(F.coalesce("place_reasons", none), F.coalesce("org_reasons", none))
    conflicts = F.array(*[F.lit(r) for r in ("explicit_distant_location", "foreign_org_owns_claim", "title_cased_foreign_org_owns_claim")])
    hard = F.arrays_overlap(F.col("found"), conflicts)
    duplicate = F.col("duplicate_facility_ids").isNotNull()
    supported = hard | (F.size(F.coalesce("matched_organizations", none)) > 0)
    extra = F.when(duplicate & supported, "detailed_duplicate_reinforces_conflict").when(duplicate, "detailed_cross_facility_duplicate")
    rows = all_facts.withColumn("found", found).withColumn("conflict", hard | (duplicate & supported)).withColumn("reasons", F.array_sort(F.array_compact(F.array_append("found", extra))))
    status = F.when(F.col("conflict"), "suspected_conflict").when(F.size("reasons") > 0, "review").otherwise("consistent_or_no_conflict")
    clean_places = F.transform(F.coalesce("matched_places", F.expr("cast(array() as array<struct<start: int, mention: string, canonical: string, geoname_id: bigint, distance_km: double>>)")), lambda p: p.dropFields("start"))
    return rows.select("bullet_id", "facility_id", status.alias("status"), F.col("conflict").alias("exclude_from_scoring"), F.col("reasons").alias("reason_codes"), clean_places.alias("matched_places"), F.coalesce("matched_organizations", none).alias("matched_organizations"), F.coalesce("duplicate_facility_ids", none).alias("duplicate_facility_ids"))


def facility_summary(facilities: DataFrame, flags: DataFrame) -> DataFrame:
    """A row for each facility: its bullets, conflicts, reviews and rejected bullets."""
    by = flags.groupBy("facility_id").agg(
        F.count("*").alias("total_bullets"),
        F.count_if(F.col("status") == "suspected_conflict").alias("suspected_conflict_bullets"),
        F.count_if(F.col("status") == "review").alias("review_bullets"),
        F.array_sort(F.collect_list(F.when(F.col("exclude_from_scoring"), F.col("bullet_id")))).alias("rejected_bullet_ids"),
    )
    named = facilities.select(F.col("unique_id").cast("string").alias("facility_id"), F.col("name").alias("facility_name"), "address_city", "address_stateOrRegion")
    rows = keep_first(named, ["facility_id"], ["facility_name", "address_city", "address_stateOrRegion"]).join(by, "facility_id", "left")
    counts = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("total_bullets", "suspected_conflict_bullets", "review_bullets")}
    return rows.withColumns({**counts, "rejected_bullet_ids": F.coalesce("rejected_bullet_ids", F.expr("cast(array() as array<string>)"))}).withColumn("has_provenance_conflict", F.col("suspected_conflict_bullets") > 0)


def detection_quality(predicted: DataFrame, labelled: DataFrame, key: str, hit: str, truth: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall of a yes/no column; rows without a prediction count as no."""
    both = labelled.select(key, F.col(truth).alias("y")).join(predicted.select(key, F.col(hit).alias("x")), key, "left").withColumn("x", F.coalesce("x", F.lit(False)))
    n = lambda x, y: F.count_if((F.col("x") == x) & (F.col("y") == y))
    counts = both.agg(n(True, True).alias("tp"), n(True, False).alias("fp"), n(False, True).alias("fn"), n(False, False).alias("tn"))
    return counts.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
