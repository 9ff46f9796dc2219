"""Facilities, bullets, flags and rules as views over the driver's tables, once for Spark and once as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text

RULES = [
    {"capability_id": "licensing", "domain": "staff", "tracer_id": "license", "pattern": r"\blicen[cs]ed?\b", "excludes": [r"\bpublic\b"], "contexts": [], "source_fields": []},
    {"capability_id": "licensing", "domain": "equipment", "tracer_id": "named_license", "pattern": r"\b(?:mit|apache|gnu)\b", "excludes": [], "contexts": [r"\blicense\b"], "source_fields": []},
    {"capability_id": "licensing", "domain": "equipment", "tracer_id": "named_license", "pattern": r"\bcreative commons\b", "excludes": [], "contexts": [], "source_fields": []},
    {"capability_id": "licensing", "domain": "procedures", "tracer_id": "released", "pattern": r"\b(?:released|reserved)\b", "excludes": [], "contexts": [], "source_fields": ["capability", "procedure"]},
    {"capability_id": "language", "domain": "staff", "tracer_id": "german", "pattern": r"\b(?:nicht|und|der)\b", "excludes": [], "contexts": [], "source_fields": []},
    {"capability_id": "language", "domain": "equipment", "tracer_id": "spanish", "pattern": r"\b(?:para|como|que)\b", "excludes": [], "contexts": [], "source_fields": []},
    {"capability_id": "language", "domain": "diagnostics", "tracer_id": "french", "pattern": r"\b(?:avec|dans|sur)\b", "excludes": [], "contexts": [], "source_fields": ["equipment"]},
    {"capability_id": "numbers", "domain": "staff", "tracer_id": "digits", "pattern": r"\b[0-9]{2,}\b", "excludes": [], "contexts": [], "source_fields": []},
]
for _i, _r in enumerate(RULES):
    _r["ord"] = _i


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def facilities(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = lambda low, m: F.when(F.col("s_suppkey") % 7 != 3, low + (F.col("s_suppkey") * m % 2900) / F.lit(100.0))
    kind = F.when(F.col("s_suppkey") % 10 == 0, "dentist").when(F.col("s_suppkey") % 10 == 1, "pharmacy").otherwise("hospital")
    return rows.select(F.col("s_suppkey").cast("string").alias("unique_id"), F.col("s_name").alias("name"), F.col("n_name").alias("address_city"), F.col("r_name").alias("address_stateOrRegion"), place(8, 37).alias("latitude"), place(68, 53).alias("longitude"), kind.alias("facilityTypeId"))


def bullets(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "supplier").agg(F.count("*").alias("n_sup"))
    lines = read(spark, sf, "documents").crossJoin(F.broadcast(n)).select("doc_id", "n_sup", F.posexplode(F.split("text", "\n")).alias("position", "text"))  # one row
    field = F.element_at(F.array(F.lit("capability"), F.lit("procedure"), F.lit("equipment")), (F.col("doc_id") % 3).cast("int") + 1)
    rows = lines.where(F.trim("text") != "").select("doc_id", (F.col("doc_id") % F.col("n_sup")).cast("string").alias("facility_id"), field.alias("source_field"), "position", "text")
    rows = rows.withColumn("bullet_id", F.concat_ws("-", "doc_id", "position"))
    return rows.withColumn("text_norm", text.normalize_ascii(F.col("text")))


def flagged(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Adds status and exclude_from_scoring to rows with a doc_id."""
    labels = read(spark, sf, "labels").select("doc_id", "toxic", "quality")
    status = F.when(F.col("toxic") == 1, "suspected_conflict").when(F.col("quality") == 0, "review").otherwise("consistent_or_no_conflict")
    return rows.join(labels, "doc_id", "left").withColumn("status", status).withColumn("exclude_from_scoring", F.col("status") == "suspected_conflict").drop("toxic", "quality")


def flags(spark: SparkSession, sf: str) -> DataFrame:
    return flagged(spark, sf, bullets(spark, sf)).select("bullet_id", "facility_id", "status", "exclude_from_scoring")


FACILITY = """SELECT CAST(s_suppkey AS VARCHAR) AS unique_id, s_name AS name, n_name AS address_city, r_name AS address_stateOrRegion,
CASE WHEN s_suppkey % 7 <> 3 THEN 8 + (s_suppkey * 37 % 2900) / 100.0::DOUBLE END AS latitude, CASE WHEN s_suppkey % 7 <> 3 THEN 68 + (s_suppkey * 53 % 2900) / 100.0::DOUBLE END AS longitude,
CASE s_suppkey % 10 WHEN 0 THEN 'dentist' WHEN 1 THEN 'pharmacy' ELSE 'hospital' END AS facilityTypeId
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
BULLET = """SELECT doc_id, CAST(doc_id % (SELECT count(*) FROM supplier) AS VARCHAR) AS facility_id, (['capability','procedure','equipment'])[doc_id % 3 + 1] AS source_field, position, text,
doc_id || '-' || position AS bullet_id, trim(regexp_replace(replace(lower(text), '&amp;', ' and '), '[^a-z0-9]+', ' ', 'g')) AS text_norm
FROM (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS position, unnest(string_split(text, chr(10))) AS text FROM documents) WHERE trim(text) <> ''"""
FLAG = """SELECT bullet_id, facility_id, status, status = 'suspected_conflict' AS exclude_from_scoring FROM (SELECT b.bullet_id, b.facility_id,
CASE WHEN toxic = 1 THEN 'suspected_conflict' WHEN quality = 0 THEN 'review' ELSE 'consistent_or_no_conflict' END AS status FROM bullet b LEFT JOIN labels l ON b.doc_id = l.doc_id)"""


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _match_sql() -> str:
    parts = []
    for r in RULES:
        p, t = r["pattern"], "text_norm"
        prefix = f"right(regexp_extract({t}, {_sql_text('(?i)^(.*?)(?:' + p + ')')}, 1), 55)"
        tests = [f"regexp_matches({t}, {_sql_text('(?i)' + p)})", f"NOT regexp_matches({prefix}, {_sql_text('(?i)' + text.NEGATION_BEFORE)})", f"NOT regexp_matches({prefix}, {_sql_text('(?i)' + text.THIRD_PARTY_BEFORE)})"]
        tests += [f"NOT regexp_matches({t}, {_sql_text('(?i)' + x)})" for x in r["excludes"]]
        if r["contexts"]:
            tests.append("(" + " OR ".join(f"regexp_matches({t}, {_sql_text('(?i)' + x)})" for x in r["contexts"]) + ")")
        fields = "[" + ", ".join(map(_sql_text, r["source_fields"])) + "]::VARCHAR[]"
        parts.append(f"SELECT text_norm, {r['ord']} AS ord, '{r['capability_id']}' AS capability_id, '{r['domain']}' AS domain, '{r['tracer_id']}' AS tracer_id, regexp_extract({t}, {_sql_text('(?i)' + p)}, 0) AS supporting_quote, {_sql_text(p)} AS matched_pattern, {fields} AS source_fields FROM texts WHERE {' AND '.join(tests)}")
    return "SELECT * EXCLUDE (ord, rank) FROM (SELECT *, row_number() OVER (PARTITION BY text_norm, capability_id, domain, tracer_id ORDER BY ord) AS rank FROM (" + "\nUNION ALL ".join(parts) + ")) WHERE rank = 1"


TOTALS = sorted({(r["capability_id"], r["domain"], r["tracer_id"]) for r in RULES})
PARTS = {
    "facility": FACILITY,
    "bullet": BULLET,
    "flag": FLAG,
    "texts": "SELECT DISTINCT text_norm FROM bullet WHERE text_norm <> ''",
    "match": _match_sql(),
    "mapped": """SELECT DISTINCT b.bullet_id, b.facility_id, b.source_field, m.capability_id, m.domain, m.tracer_id, m.supporting_quote, m.matched_pattern, f.status AS provenance_status, f.exclude_from_scoring
FROM bullet b JOIN match m USING (text_norm) JOIN flag f ON b.bullet_id = f.bullet_id WHERE len(m.source_fields) = 0 OR list_contains(m.source_fields, b.source_field)""",
    "total": "SELECT capability_id, domain, count(*) AS n_tracers FROM (VALUES " + ", ".join(f"('{c}', '{d}', '{t}')" for c, d, t in TOTALS) + ") AS v(capability_id, domain, tracer) GROUP BY ALL",
    "grid": "SELECT f.unique_id AS facility_id, t.capability_id, t.domain, t.n_tracers FROM facility f CROSS JOIN total t",
    "domain_score": """SELECT g.facility_id, g.capability_id, g.domain, round_even(coalesce(n, 0) / g.n_tracers, 4) AS score FROM grid g LEFT JOIN
(SELECT facility_id, capability_id, domain, count(DISTINCT tracer_id) AS n FROM mapped WHERE NOT exclude_from_scoring GROUP BY ALL) m ON g.facility_id = m.facility_id AND g.capability_id = m.capability_id AND g.domain = m.domain""",
    "readiness": """SELECT s.facility_id, s.capability_id, s.readiness_score, coalesce(t, 0) AS distinct_tracer_count, coalesce(b, 0) AS distinct_bullet_count, coalesce(sf, 0) AS distinct_source_field_count, coalesce(n, 0) AS completeness_bullet_count,
coalesce(t, 0) >= 2 AND coalesce(sf, 0) >= 2 AS conditional_pass, CASE WHEN coalesce(t, 0) = 0 OR coalesce(n, 0) < 5 THEN 'insufficient_evidence' WHEN t >= 2 AND sf >= 2 THEN 'corroborated' ELSE 'claimed_only' END AS verdict
FROM (SELECT facility_id, capability_id, round_even(avg(score), 4) AS readiness_score FROM domain_score GROUP BY ALL) s
LEFT JOIN (SELECT facility_id, capability_id, count(DISTINCT tracer_id) AS t, count(DISTINCT bullet_id) AS b, count(DISTINCT source_field) AS sf FROM mapped WHERE NOT exclude_from_scoring GROUP BY ALL) m ON s.facility_id = m.facility_id AND s.capability_id = m.capability_id
LEFT JOIN (SELECT facility_id, count(*) AS n FROM bullet GROUP BY ALL) c ON s.facility_id = c.facility_id""",
}
NEEDS = {"flag": ["bullet"], "texts": ["bullet"], "match": ["texts"], "mapped": ["bullet", "match", "flag"], "grid": ["facility", "total"], "domain_score": ["grid", "mapped"], "readiness": ["domain_score", "mapped", "bullet"]}


def sql(query: str, *parts: str) -> str:
    """The query with the views that it and they need."""
    order: list[str] = []

    def need(p: str) -> None:
        for x in NEEDS.get(p, []):
            need(x)
        if p not in order:
            order.append(p)

    for p in parts:
        need(p)
    return ("WITH " + ",\n".join(f"{p} AS ({PARTS[p]})" for p in order) + "\n" if order else "") + query


def distance_sql(lat: str, lon: str, lat2: str, lon2: str) -> str:
    return f"2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(({lat2}) - ({lat})) / 2), 2) + cos(radians({lat})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon})) / 2), 2))))"
