"""Corroboration candidates and sources, shortlists, and the pre-flight checks of raw facilities."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import geo, text
from factloom.operators.bullets import keep_first
from factloom.operators.phrases import bounded_substrings
from factloom.sources.tables import insert_absent

#: What is known of a pair after corroboration; the first seven columns are given, the others found.
CORROBORATION = "facility_id string, facility_name string, facility_city string, capability_id string, query string, cache_key string, known_source_count int, status string, exact_quote string, source_url string, source_tier string, reason string, facility_identity_match boolean"
FOUND = ["status", "exact_quote", "source_url", "source_tier", "reason", "facility_identity_match"]
METADATA = {"name": "facility_name", "address_city": "facility_city", "address_stateOrRegion": "facility_state", "officialWebsite": "official_website", "websites": "websites", "source_urls": "source_urls"}


def select_candidates(mapped: DataFrame, per_capability: int = 10, total: int = 100) -> DataFrame:
    """Pairs with the broadest evidence: of each capability the first by domains, tracers, rows and id; then the first of all."""
    pairs = mapped.groupBy("facility_id", "capability_id").agg(F.count("*").alias("n_rows"), F.countDistinct("tracer_id").alias("n_tracers"), F.countDistinct("domain").alias("n_domains"))
    order = [F.desc("n_domains"), F.desc("n_tracers"), F.desc("n_rows"), F.asc("facility_id")]
    top = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("capability_id").orderBy(*order))).where(F.col("rank") <= per_capability).drop("rank")
    return top.orderBy("capability_id", *order).limit(total)


def with_metadata(candidates: DataFrame, facilities: DataFrame, columns: list[str]) -> DataFrame:
    first = keep_first(facilities.select(F.col("unique_id").cast("string").alias("facility_id"), *columns), ["facility_id"], columns)
    return candidates.join(first, "facility_id", "left")


def merge_sources(sources: DataFrame) -> DataFrame:
    """url, official, ord → each URL once (the last entry wins) with its tier, in order of tiers as text."""
    last = keep_first(sources, ["url"], [F.desc("ord")])
    return last.withColumn("tier", text.source_tier(F.col("url"), F.col("official"))).orderBy("tier", "ord", "url")


def known_sources(official: Column, *lists: Column) -> Column:
    """array<struct<url, title, content, source_tier, origin>> of a facility's own URLs: those of JSON lists, then its website, each once, the better tiers first."""
    own = F.when(F.coalesce(official, F.lit("")) != "", F.array(official)).otherwise(F.expr("cast(array() as array<string>)"))
    urls = F.transform(F.concat(*[text.url_list(c) for c in lists], own), lambda u: F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u)))
    ranked = F.array_sort(F.transform(F.array_distinct(urls), lambda u, i: F.struct(text.source_tier(u, official).alias("source_tier"), i.alias("i"), u.alias("url"))))
    return F.transform(ranked, lambda r: F.struct(r["url"].alias("url"), F.lit("Existing facility source").alias("title"), F.lit("").alias("content"), r["source_tier"].alias("source_tier"), F.lit("existing_source_url").alias("origin")))


def prepare_corroboration(candidates: DataFrame, facilities: DataFrame) -> DataFrame:
    """The candidates with what is asked for each: facility, query, cache_key, sources, known_source_count."""
    named = with_metadata(candidates, facilities, list(METADATA)).withColumnsRenamed(METADATA)
    query = text.search_query(F.col("facility_name"), F.col("facility_city"), F.col("facility_state"), F.col("capability_id"))
    sources = known_sources(F.col("official_website"), F.col("source_urls"), F.col("websites"))
    rows = named.withColumn("query", query).withColumn("cache_key", text.cache_key(F.col("facility_id"), F.col("capability_id"), F.col("query"))).withColumn("sources", sources)
    return rows.withColumn("known_source_count", F.size("sources")).drop("official_website", "websites", "source_urls")


def bound_answer(answer: dict, sources: list[dict]) -> dict:
    """The answer if its quote stands word by word in the source that it names, or has none; else an unverified one."""
    quote, url = str(answer.get("exact_quote") or ""), str(answer.get("source_url") or "")
    if quote and not any(s["url"] == url and quote in (s.get("content") or "") for s in sources):
        return {"status": "unverified", "exact_quote": "", "source_url": "", "source_tier": "", "reason": "the quote does not stand in the source", "facility_identity_match": None}
    filled = {"status": "unverified", "exact_quote": "", "source_url": "", "source_tier": "", "reason": "", "facility_identity_match": None}
    return {k: answer.get(k, v) for k, v in filled.items()}


def corroborate(asked: DataFrame, cache: DataFrame | None, search: Callable[[str], list[dict]] | None, extract: Callable[[dict, list[dict]], dict] | None, refresh: bool = False) -> DataFrame:
    """CORROBORATION rows and `fresh` for prepare_corroboration's rows.

    Pairs whose cache_key is in the cache (rows of this form) keep what it says, unless refresh. For the others search(query) adds sources (url, content; of a
    URL named twice the later entry counts), extract(row, sources) answers, and only quotes that stand in their source count. Any failure gives an unverified row with its
    kind, never a negative answer. Without search or extract: a dry run, which calls nothing.
    """
    columns = [c.split()[0] for c in CORROBORATION.split(", ")]
    dry = search is None or extract is None
    use = cache is not None and not refresh
    known = asked.select(*[c for c in columns if c not in FOUND]).join(cache.select("cache_key", *FOUND).dropDuplicates(["cache_key"]), "cache_key").select(*columns).withColumn("fresh", F.lit(False)) if use else None
    rest = asked.join(cache.select("cache_key").distinct(), "cache_key", "left_anti") if use else asked

    def answer(row: dict) -> dict:
        sources = [dict(s) for s in json.loads(row["sources"])]
        if dry:
            return {"status": "dry_run", "exact_quote": "", "source_url": "", "source_tier": "", "reason": f"{len(sources)} known sources; nothing was called", "facility_identity_match": None, "known_source_count": len(sources)}
        try:
            found = [dict(s, source_tier=s.get("source_tier") or "C_other_web") for s in search(row["query"])]
            sources = sorted({s["url"]: s for s in [*sources, *found]}.values(), key=lambda s: s["source_tier"])
            said = bound_answer(extract(row, sources), sources)
        except Exception as e:  # noqa: BLE001  one bad answer must not end the run, and says nothing about the facility
            said = {"status": "unverified", "exact_quote": "", "source_url": "", "source_tier": "", "reason": f"failed safely: {type(e).__name__}", "facility_identity_match": None}
        return said | {"known_source_count": len(sources)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{k: v for k, v in r.items() if k != "sources"} | answer(r) | {"fresh": not dry} for r in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=[*columns, "fresh"])

    given = [c for c in columns if c not in FOUND]
    fresh = rest.select(*given, F.to_json("sources").alias("sources")).mapInPandas(run, CORROBORATION + ", fresh boolean")
    return fresh if known is None else known.unionByName(fresh)


def corroboration_summary(results: DataFrame, mapped: DataFrame, per_capability: int = 10, total: int = 100) -> DataFrame:
    """One row: pairs available and selected, the caps, calls (two for each fresh row that didn't fail at the search), status counts by name."""
    available = mapped.select("facility_id", "capability_id").distinct().agg(F.count("*").alias("pairs_available"))
    status = results.groupBy("status").agg(F.count("*").alias("n"))
    counts = status.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"))
    totals = results.agg(F.count("*").alias("pairs_selected"), F.count_if("fresh").alias("fresh_pairs"))
    return available.crossJoin(totals).crossJoin(counts).withColumn("per_capability_cap", F.lit(per_capability)).withColumn("total_cap", F.lit(total))  # one row each


def save_shortlist(spark, path: str, user: str, facility: str, capability: str, context: dict, verdict: str, distance: float, saved_at: str) -> bool:
    """Whether the item is new. user: white space collapsed, 120 characters at most, not empty."""
    name = " ".join(user.split())[:120]
    if not name:
        raise ValueError("a user name is needed")
    row = (name, facility, capability, json.dumps(context, sort_keys=True, separators=(",", ":")), verdict, distance, saved_at)
    new = spark.createDataFrame([row], "user_name string, facility_id string, capability_id string, query_context string, verdict string, distance_km double, saved_at string")
    return insert_absent(new, path, ["user_name", "facility_id", "capability_id", "query_context"]) == 1


def read_shortlist(spark, path: str, user: str) -> DataFrame:
    """A user's items (in any case of letters), the latest first."""
    own = spark.read.parquet(path)
    return own.where(F.lower("user_name") == " ".join(user.split())[:120].lower()).orderBy(F.desc("saved_at"), "facility_id")


def contamination_scan(bullets: DataFrame, facilities: DataFrame) -> DataFrame:
    """facility_id, cities, orgs, strong: other facilities' cities and names in a facility's bullets; strong: a city without digits or a name of several words."""
    squeezed = bullets.select("bullet_id", "facility_id", text.squeeze(F.col("text")).alias("t"))
    own = facilities.select(F.col("unique_id").cast("string").alias("facility_id"), text.squeeze(F.col("address_city")).alias("city"), text.squeeze(F.col("name")).alias("org"))
    found = None
    for kind in ("city", "org"):
        hits = bounded_substrings(squeezed, own.where(F.length(kind) >= 3), "bullet_id", "t", kind)
        hits = hits.join(squeezed.select("bullet_id", "facility_id"), "bullet_id").join(own.select("facility_id", kind), "facility_id").where(F.col("phrase") != F.col(kind))
        rows = hits.select("facility_id", F.lit(kind).alias("kind"), "phrase")
        found = rows if found is None else found.union(rows)
    strong = ((F.col("kind") == "city") & ~F.col("phrase").rlike("[0-9]")) | ((F.col("kind") == "org") & F.col("phrase").contains(" "))
    named = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("phrase"))))
    return found.groupBy("facility_id").agg(named("city").alias("cities"), named("org").alias("orgs"), F.bool_or(strong).alias("strong"))


def source_histogram(facilities: DataFrame, column: str) -> DataFrame:
    """bucket, n, pct of the number of distinct items, of any kind, in a JSON array column; all buckets in order."""
    spark = facilities.sparkSession
    buckets = spark.createDataFrame([(0, "1"), (1, "2-4"), (2, "5+")], "ord int, bucket string")
    n = F.coalesce(F.size(F.array_distinct(F.transform(text.json_items(F.col(column)), lambda v: F.to_json(v)))), F.lit(0))
    counts = facilities.select(text.source_bucket(n).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    rows = buckets.join(counts, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("pct", F.coalesce(geo.rounded(100 * F.try_divide("n", F.sum("n").over(Window.partitionBy())), 1), F.lit(0.0))).orderBy("ord").drop("ord")


def aligned(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """key, position, left, right: two arrays side by side, the shorter filled with nulls; only rows with both."""
    both = df.where((F.size(left) > 0) & (F.size(right) > 0))
    return both.select(key, F.posexplode(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r"))).alias("position", "z")).select(key, "position", F.col("z.l").alias(left), F.col("z.r").alias(right))


def alignment_report(facilities: DataFrame, left: str, right: str, n: int = 30, seed: int = 42, key: str = "unique_id") -> DataFrame:
    """key, name, n_left, n_right, pairs (index, left, right) of a seeded sample of the rows whose two JSON arrays both have items; a key that is listed twice counts once."""
    first = keep_first(facilities.select(key, "name", left, right), [key], ["name", left, right])
    items = first.select(key, "name", text.item_texts(F.col(left)).alias("l"), text.item_texts(F.col(right)).alias("r")).where((F.size("l") > 0) & (F.size("r") > 0))
    drawn = sample_rows(items, {"": (F.lit(True), n)}, seed, key)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("l"), F.size("r")) - 1), lambda i: F.struct(i.alias("index"), F.get("l", i).alias("left"), F.get("r", i).alias("right")))
    return drawn.select("place", key, "name", F.size("l").alias("n_left"), F.size("r").alias("n_right"), pairs.alias("pairs"))


def sample_rows(df: DataFrame, strata: dict[str, tuple[Column, int]], seed: int, key: str) -> DataFrame:
    """The rows of a seeded sample with `stratum` and `place` (from 1, in an order shuffled by the seed). strata: name to condition and most rows; a row goes to the first that holds.

    Rows are drawn and shuffled by hashes of seed and key, so the same rows come whatever the partitions; each stratum is a distributed top-n.
    """
    name = F.lit(None).cast("string")
    for stratum, (condition, _) in reversed(strata.items()):
        name = F.when(condition, stratum).otherwise(name)
    named = df.withColumn("stratum", name)
    drawn = None
    for stratum, (_, n) in strata.items():
        own = named.where(F.col("stratum") == stratum).orderBy(text.drawn_by(seed, key), key).limit(n)
        drawn = own if drawn is None else drawn.unionByName(own)
    shuffled = Window.partitionBy(F.lit(1)).orderBy(text.drawn_by(seed + 1, key), key)  # the sample only
    return drawn.withColumn("place", F.row_number().over(shuffled))


def bucket_agreement(scanned: DataFrame, judged: DataFrame, key: str = "unique_id") -> DataFrame:
    """Counts of the scan's obvious and borderline rows by what a judge says of them, and precision and recall (three decimals) of the obvious bucket. scanned: key, obvious; judged: key, genuine."""
    both = judged.select(key, "genuine").join(scanned.select(key, "obvious"), key)
    n = lambda c: F.count_if(c)
    obvious, genuine = F.col("obvious"), F.col("genuine")
    counts = both.agg(
        F.count("*").alias("n_sampled"), n(obvious).alias("obvious"), n(~obvious).alias("borderline"), n(genuine).alias("genuine"),
        n(obvious & genuine).alias("obvious_confirmed"), n(obvious & ~genuine).alias("obvious_rejected"), n(~obvious & genuine).alias("borderline_confirmed"), n(~obvious & ~genuine).alias("borderline_rejected"),
    )
    return counts.withColumn("precision", geo.rounded(F.try_divide("obvious_confirmed", "obvious"), 3)).withColumn("recall", geo.rounded(F.try_divide("obvious_confirmed", "genuine"), 3))


ANSWERS = "map<string, array<struct<capability_id: string, domain: string, tracer_id: string, supporting_quote: string>>>"


def validated_answers(answers: DataFrame, rules: DataFrame) -> DataFrame:
    """text, capability_id, domain, tracer_id, supporting_quote from a model's answers to batches of texts: rows (batch_id, batch, raw; at, of a text asked twice the latest batch counts).

    raw: text with one JSON object from place in the batch to matches. A place outside the batch, a tracer that the rules don't have, and a quote that doesn't stand in the text are dropped.
    Each text goes on with its own matches, never with those of its whole batch.
    """
    at = F.col("at") if "at" in answers.columns else F.col("batch_id")
    said = F.map_entries(F.from_json(F.regexp_extract("raw", r"(?s)\{.*\}", 0), ANSWERS))
    placed = F.transform(said, lambda e: F.struct(F.trim(e["key"]).try_cast("int").alias("place"), e["value"].alias("matches")))
    own = lambda r, i: F.flatten(F.transform(F.filter(r["said"], lambda e: (e["place"] == i) & e["matches"].isNotNull()), lambda e: e["matches"]))
    valid = lambda matches, t: F.filter(matches, lambda m: (F.coalesce(m["supporting_quote"], F.lit("")) != "") & t.contains(m["supporting_quote"]))
    # an array of one, so that the answer is read once and not for each text
    each = F.transform(F.array(F.struct("batch", placed.alias("said"))), lambda r: F.transform(r["batch"], lambda t, i: F.struct(i.alias("place"), t.alias("text"), valid(own(r, i), t).alias("matches"))))[0]
    asked = answers.select(at.alias("at"), F.inline_outer(each)).where("text is not null")
    last = keep_first(asked, ["text"], [F.desc("at"), F.desc("place")])
    found = last.select("text", F.explode("matches").alias("m")).select("text", "m.*")
    return found.join(F.broadcast(rules.select("capability_id", "domain", "tracer_id").distinct()), ["capability_id", "domain", "tracer_id"], "left_semi").select("text", "capability_id", "domain", "tracer_id", "supporting_quote")


def answers_to_bullets(found: DataFrame, bullets: DataFrame, flags: DataFrame, model: str) -> DataFrame:
    """The matches of texts back at their bullets, with the model's name and the bullet's provenance (null without a flag)."""
    rows = bullets.select("bullet_id", "facility_id", "source_field", "text").join(found, "text").drop("text").withColumn("llm_model", F.lit(model))
    return rows.join(flags.select("bullet_id", F.col("status").alias("provenance_status"), "exclude_from_scoring"), "bullet_id", "left")
