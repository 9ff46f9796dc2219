"""Readiness of every facility × capability pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import geo

COMPLETENESS_FLOOR = 5
# Claims that need another tracer beside them.
CONTRADICTIONS = [
    {"capability_id": "general_surgery", "claims": ["general_surgery_service", "hernia_repair", "appendectomy", "cholecystectomy"], "required": "operation_theatre", "message": "general_surgery claimed with no operation theatre evidenced"},
    {"capability_id": "icu", "claims": ["icu_service", "mechanical_ventilation"], "required": "ventilator", "message": "icu claimed with no ventilator evidence"},
]


def readiness(mapped: DataFrame, facilities: DataFrame, totals: DataFrame, bullet_counts: DataFrame, contradictions: list[dict] | None = None) -> DataFrame:
    """A row for each facility and capability. totals: capability_id, domain, n_tracers; bullet_counts: facility_id, n_bullets.

    Counts are over accepted rows; the mean of domain scores is over the domains that the capability has, zeros included, of scores already rounded.
    """
    accepted = ~F.col("exclude_from_scoring")
    keys = ["facility_id", "capability_id"]
    ids = lambda c, when=None: F.array_sort(F.collect_set(F.when(when, F.col(c)) if when is not None else F.col(c)))
    # one aggregate over the map: counts are the sizes of sets, those of domains come from pairs of domain and tracer, which are few
    groups = mapped.groupBy(*keys).agg(
        F.collect_set(F.when(accepted, F.struct("domain", "tracer_id"))).alias("factloom_pairs"),
        ids("source_field", accepted).alias("factloom_fields"),
        ids("bullet_id", accepted).alias("supporting_bullet_ids"),
        ids("bullet_id", ~accepted).alias("rejected_bullet_ids"),
        ids("provenance_status").alias("provenance_flags"),
    )
    groups = groups.withColumn("tracers", F.array_sort(F.array_distinct(F.array_compact(F.transform("factloom_pairs", lambda p: p["tracer_id"])))))
    sizes = {"distinct_tracer_count": "tracers", "distinct_bullet_count": "supporting_bullet_ids", "distinct_source_field_count": "factloom_fields"}
    groups = groups.withColumns({k: F.size(c) for k, c in sizes.items()}).drop("factloom_fields")
    own = totals.groupBy("capability_id").agg(F.array_sort(F.collect_list(F.struct("domain", "n_tracers"))).alias("factloom_domains"))
    # densification: every pair has a row
    grid = facilities.select("facility_id").distinct().crossJoin(F.broadcast(own)).join(groups, keys, "left")
    n = lambda d: F.coalesce(F.size(F.filter("factloom_pairs", lambda p: (p["domain"] == d["domain"]) & p["tracer_id"].isNotNull())), F.lit(0))
    shares = F.transform("factloom_domains", lambda d: F.struct(d["domain"].alias("domain"), (n(d) / d["n_tracers"]).alias("x")))
    scores = F.transform(shares, lambda e: F.struct(e["domain"].alias("domain"), geo.rounded(e["x"], 4).alias("score")))
    scored = grid.withColumn("factloom_scores", scores)
    scored = scored.withColumn("factloom_mean", F.aggregate("factloom_scores", F.lit(0.0), lambda total, e: total + e["score"]) / F.size("factloom_scores"))
    scored = scored.withColumn("domain_scores", F.map_from_entries("factloom_scores")).withColumn("readiness_score", geo.rounded(F.col("factloom_mean"), 4)).drop("factloom_pairs", "factloom_domains", "factloom_scores", "factloom_mean")
    none = F.expr("cast(array() as array<string>)")
    rows = scored.join(bullet_counts.select("facility_id", F.col("n_bullets").alias("completeness_bullet_count")), "facility_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("distinct_tracer_count", "distinct_bullet_count", "distinct_source_field_count", "completeness_bullet_count")})
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("tracers", "supporting_bullet_ids", "rejected_bullet_ids", "provenance_flags")})
    passes = (F.col("distinct_tracer_count") >= 2) & (F.col("distinct_source_field_count") >= 2)
    messages = [
        F.when((F.col("capability_id") == r["capability_id"]) & F.arrays_overlap("tracers", F.array(*[F.lit(c) for c in r["claims"]])) & ~F.array_contains("tracers", r["required"]), r["message"])
        for r in (CONTRADICTIONS if contradictions is None else contradictions)
    ]
    verdict = F.when((F.col("distinct_tracer_count") == 0) | (F.col("completeness_bullet_count") < COMPLETENESS_FLOOR), "insufficient_evidence").when(passes, "corroborated").otherwise("claimed_only")
    return rows.withColumn("conditional_pass", passes).withColumn("contradiction_flags", F.array_compact(F.array(*messages)) if messages else none).withColumn("verdict", verdict).drop("tracers")


def contradiction_applicable(mapped: DataFrame, contradictions: list[dict] | None = None) -> DataFrame:
    """n_applicable: pairs with accepted claims that a contradiction rule looks at."""
    by = mapped.where(~F.col("exclude_from_scoring")).groupBy("facility_id", "capability_id").agg(F.collect_set("tracer_id").alias("tracers"))
    test = F.lit(False)
    for r in CONTRADICTIONS if contradictions is None else contradictions:
        test = test | ((F.col("capability_id") == r["capability_id"]) & F.arrays_overlap("tracers", F.array(*[F.lit(c) for c in r["claims"]])))
    return by.where(test).agg(F.count("*").alias("n_applicable"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Values of a column, nulls too, with their number and percentage (0 for no rows)."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("factloom_total"))  # one row
    return n.crossJoin(F.broadcast(total)).select(column, "n", F.coalesce(geo.rounded(100 * F.try_divide("n", "factloom_total"), 2), F.lit(0.0)).alias("pct"))


#: Parts that a range of values is dealt into by each round of `quantiles`.
PARTS = 1 << 16


def quantiles(df: DataFrame, column: str, at: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """The exact quantiles, interpolated between the two nearest ranks, without all values in one task.

    Values are counted by their logarithm (rounded), which gives the part that each rank asked for is in; the values of these parts by PARTS equal parts of each part's range, twice;
    then what is left by value. Each count has some 65,000 rows for a rank at most, or as many as there are parts of logarithms, and the last those of a range of about 2 ** -42 of its values' size.
    """
    x = F.col("x")
    rows = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    log = F.floor(F.log(F.abs(x)) * 1000).cast("long") + 1_000_000
    part = F.when(F.isnan(x), 1 << 40).when(F.abs(x) == float("inf"), F.signum(x) * (1 << 39)).when(x == 0, 0).otherwise(F.signum(x) * log).cast("long")
    figures = [F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high")]
    before = lambda *keys: F.sum("c").over(Window.partitionBy(*keys).orderBy("part")) - F.col("c")
    counts = rows.groupBy(part.alias("part")).agg(*figures).withColumn("before", before()).withColumn("n", F.sum("c").over(Window.partitionBy()))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), side.cast("long").alias("rank")) for i, q in enumerate(at) for side in ((F.floor(q * (F.col("n") - 1))), F.ceil(q * (F.col("n") - 1)))])
    found = counts.select("*", F.explode(F.array_distinct(ranks)).alias("r")).select("part", "low", "high", "before", "c", "n", "r.*").where("rank >= before and rank < before + c")
    found = found.select("i", "rank", "n", "low", "high", (F.col("rank") - F.col("before")).alias("left"))
    for last in (False, False, True):
        width = F.col("high") - F.col("low")
        step = x if last else F.when(F.col("low") == F.col("high"), 0).otherwise(F.floor((x - F.col("low")) / width * (PARTS - 1)))
        inside = rows.join(F.broadcast(found), x.between(F.col("low"), F.col("high")))  # two rows for each quantile
        keys = ["i", "rank", "n", "left"]
        counts = inside.groupBy(*keys, step.alias("part")).agg(*figures).withColumn("before", before("i", "rank"))
        found = counts.where("left >= before and left < before + c").select("i", "rank", "n", "low", "high", (F.col("left") - F.col("before")).alias("left"))
    ends = found.groupBy("i").agg(F.max("n").alias("n"), F.min_by("low", "rank").alias("a"), F.max_by("low", "rank").alias("b"))
    place = F.element_at(F.array(*[F.lit(float(q)) for q in at]), F.col("i") + 1) * (F.col("n") - 1)
    value = F.when((F.col("a") == F.col("b")) | (F.abs("a") == float("inf")) | (F.floor(place) == F.ceil(place)), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place)))
    return ends.select("i", value.alias("v")).agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"p{round(q * 100)}") for i, q in enumerate(at)])
