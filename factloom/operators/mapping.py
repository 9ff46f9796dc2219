"""Taxonomy rules over distinct texts, and the capability map of bullets."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.sources.tables import require_columns

# The capabilities and domains that a taxonomy may name.
CAPABILITIES = "dialysis icu maternity nicu emergency trauma oncology cardiac general_surgery blood_bank pediatric_intensive_care stroke_care neurosurgery orthopaedic_surgery respiratory_care gastroenterology urology ophthalmology diagnostic_imaging mental_health".split()
DOMAINS = "staff equipment procedures diagnostics".split()
FIELDS = ["capability", "procedure", "equipment"]
FLAGS = "(?iuU)"


def rules_of(taxonomy: dict, capabilities: list[str] | None = None, domains: list[str] | None = None) -> list[dict]:
    """The rules of a taxonomy (capability → domain → tracers) in order, one for each include pattern; ValueError says what is wrong with it."""
    capabilities, domains = capabilities or CAPABILITIES, domains or DOMAINS
    tree = taxonomy.get("capabilities", taxonomy)
    if set(tree) != set(capabilities):
        raise ValueError(f"capabilities missing {sorted(set(capabilities) - set(tree))}, unknown {sorted(set(tree) - set(capabilities))}")
    rules = []
    for capability, parts in tree.items():
        parts = parts.get("domains", parts)
        if unknown := set(parts) - set(domains):
            raise ValueError(f"{capability} has unknown domains {sorted(unknown)}")
        seen: set[str] = set()
        for domain, tracers in parts.items():
            for tracer in tracers:
                name = tracer.get("tracer_id")
                if not name or name in seen:
                    raise ValueError(f"{capability} has a tracer without a name or twice: {name}")
                seen.add(name)
                lists = {k: tracer.get(k) or [] for k in ("include_patterns", "exclude_patterns", "context_patterns", "source_fields")}
                if any(not isinstance(v, list) or not all(isinstance(x, str) for x in v) for v in lists.values()) or not lists["include_patterns"]:
                    raise ValueError(f"{name}: patterns and fields are lists of text, and there is at least one include pattern")
                for pattern in [p for k in ("include_patterns", "exclude_patterns", "context_patterns") for p in lists[k]]:
                    re.compile(pattern, re.I)
                rules += [{"ord": len(rules) + i, "capability_id": capability, "domain": domain, "tracer_id": name, "pattern": p, "excludes": lists["exclude_patterns"], "contexts": lists["context_patterns"], "source_fields": lists["source_fields"]} for i, p in enumerate(lists["include_patterns"])]
    return rules


def rule_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    return spark.createDataFrame(rules, "ord int, capability_id string, domain string, tracer_id string, pattern string, excludes array<string>, contexts array<string>, source_fields array<string>")


def domain_totals(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """capability_id, domain, n_tracers."""
    return rule_table(spark, rules).groupBy("capability_id", "domain").agg(F.countDistinct("tracer_id").alias("n_tracers"))


def _plain(pattern: str) -> bool:
    """Whether a pattern says the same of texts of ASCII with and without Unicode's classes and cases."""
    return pattern.isascii() and not re.search(r"\\[^bBdDsSwW.^$|?*+()\[\]{}/&#'\"-]|\[\[?:|\(\?[^:=!<]", pattern)


def _alternation(patterns: list[str]) -> str:
    """One pattern for all. Those that begin with a word's border and have no | outside brackets share it, so it is looked for once."""
    shared = [p[2:] for p in patterns if p.startswith(r"\b") and "|" not in re.sub(r"\((?:[^()\\]|\\.)*\)", "", p) and not re.search(r"\[[^\]]*[()]", p)]
    own = [p for p in patterns if not (p.startswith(r"\b") and p[2:] in shared)]
    return "|".join([*([r"\b(?:" + "|".join(f"(?:{p})" for p in shared) + ")"] if shared else []), *[f"(?:{p})" for p in own]])


def _by_ascii(t: Column, patterns: list[str], of: Callable[[str], Column]) -> Column:
    """of(flags): without Unicode's classes, which take several times as long, where neither text nor patterns need them."""
    every = of(FLAGS)
    return F.when(F.octet_length(t) == F.length(t), of("(?i)")).otherwise(every) if all(map(_plain, patterns)) else every


def _gate(t: Column, rules: list[dict]) -> Column:
    patterns = [r["pattern"] for r in rules]
    return (F.trim(t) != "") & _by_ascii(t, patterns, lambda flags: F.regexp_like(t, F.lit(f"{flags}(?:{_alternation(patterns)})")))


def _hit(t: Column, rule: dict, flags: str) -> Column:
    """struct(ord, quote) where the rule's first hit stands unblocked, else null."""
    pattern = flags + f"(?:{rule['pattern']})"
    quote = F.regexp_extract(t, pattern, 0)
    prefix = F.left(t, F.regexp_instr(t, F.lit(pattern)) - 1)
    ok = F.regexp_like(t, F.lit(pattern)) & ~text.blocked_before(F.right(prefix, F.lit(55)))
    for p in rule["excludes"]:
        ok = ok & ~F.regexp_like(t, F.lit(flags + f"(?:{p})"))
    if rule["contexts"]:
        ok = ok & F.regexp_like(t, F.lit(flags + "(?:" + "|".join(f"(?:{p})" for p in rule["contexts"]) + ")"))
    return F.when(ok, F.struct(F.lit(rule["ord"]).alias("ord"), quote.alias("supporting_quote")))


def _hits(t: Column, rules: list[dict]) -> Column:
    """array<struct(ord, quote)>: of each tracer the first rule, by ord, whose hit stands unblocked."""
    tracers: dict[tuple, list[dict]] = {}
    for r in sorted(rules, key=lambda r: r["ord"]):
        tracers.setdefault((r["capability_id"], r["domain"], r["tracer_id"]), []).append(r)
    patterns = [p for r in rules for p in (r["pattern"], *r["excludes"], *r["contexts"])]
    return F.array_compact(_by_ascii(t, patterns, lambda flags: F.array(*[F.coalesce(*[_hit(t, r, flags) for r in of]) if len(of) > 1 else _hit(t, of[0], flags) for of in tracers.values()])))


def _found(rows: DataFrame, hits: Column, rules: list[dict]) -> DataFrame:
    """A row for each hit, with what its rule says. explode_outer: explode would have the hits made twice, the first time for a filter."""
    table = rule_table(rows.sparkSession, rules).withColumnRenamed("pattern", "matched_pattern").drop("excludes", "contexts")
    return rows.select("*", F.explode_outer(hits).alias("factloom_hit")).where("factloom_hit is not null").select(*rows.columns, "factloom_hit.*").join(F.broadcast(table), "ord").drop("ord")


def gated(texts: DataFrame, rules: list[dict], column: str = "text") -> DataFrame:
    """The rows whose text has some pattern; the others match no rule. No plain filter, as that would be pushed below what the text is made by, which would be done twice."""
    one = F.explode_outer(F.when(_gate(F.col(column), rules), F.array(F.lit(True))))
    return texts.withColumn("factloom_gate", one).where("factloom_gate").drop("factloom_gate")


def match_texts(texts: DataFrame, rules: list[dict], column: str = "text") -> DataFrame:
    """text, capability_id, domain, tracer_id, supporting_quote, matched_pattern, source_fields: of each tracer the first unblocked rule, for distinct texts.

    One alternation of all patterns lets most texts go; only the others see the rules one by one.
    """
    asked = gated(texts.select(F.col(column).alias("text")), rules).distinct()
    return _found(asked, _hits(F.col("text"), rules), rules).select("text", "capability_id", "domain", "tracer_id", "supporting_quote", "matched_pattern", "source_fields")


def map_bullets(bullets: DataFrame, rules: list[dict], column: str = "text") -> DataFrame:
    """The bullets' columns with those of match_texts but source_fields, a row for each match whose tracer takes the bullet's field: match_texts and its way back in one pass, without moving a text."""
    t = F.col(column)
    rows = _found(bullets, F.when(_gate(t, rules), _hits(t, rules)), rules)
    return rows.where((F.size("source_fields") == 0) | F.array_contains("source_fields", F.col("source_field"))).drop("source_fields")


def as_map(rows: DataFrame) -> DataFrame:
    """The columns of the capability map, each row once."""
    return rows.select("bullet_id", "facility_id", "source_field", "capability_id", "domain", "tracer_id", "supporting_quote", "matched_pattern", F.lit("regex_taxonomy").alias("matcher_method"), "provenance_status", "exclude_from_scoring").distinct()


def capability_map(bullets: DataFrame, matches: DataFrame, flags: DataFrame) -> DataFrame:
    """Every match back at its bullets, where the tracer takes the bullet's field, with the bullet's provenance. Raises where a bullet has no flag."""
    require_columns(flags, ["bullet_id", "status", "exclude_from_scoring"], "flags")
    rows = bullets.select("bullet_id", "facility_id", "source_field", "text").join(matches, "text")
    rows = rows.where((F.size("source_fields") == 0) | F.array_contains("source_fields", F.col("source_field")))
    status = flags.select("bullet_id", F.col("status").alias("provenance_status"), "exclude_from_scoring")
    rows = rows.join(status, "bullet_id", "left").withColumn("provenance_status", F.when(F.col("exclude_from_scoring").isNull(), F.raise_error(F.concat(F.lit("no provenance flag for bullet "), "bullet_id"))).otherwise(F.col("provenance_status")))
    return as_map(rows)


def verify_map(mapped: DataFrame, bullets: DataFrame, flags: DataFrame) -> DataFrame:
    """How many rows break each promise of the map: a bullet without text, a quote that isn't in it, a flag that differs, a key twice."""
    rows = mapped.join(bullets.select("bullet_id", "text"), "bullet_id", "left").join(flags.select("bullet_id", F.col("exclude_from_scoring").alias("flag")), "bullet_id", "left")
    doubled = mapped.groupBy("bullet_id", "capability_id", "domain", "tracer_id").count().where("count > 1").agg(F.count("*").alias("repeated_keys"))  # one row
    figures = rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("text").isNull()).alias("without_bullet"),
        F.count_if(~F.col("text").contains(F.col("supporting_quote")) | (F.col("supporting_quote") == "")).alias("quote_not_in_text"),
        F.count_if(~F.col("flag").eqNullSafe(F.col("exclude_from_scoring"))).alias("flag_differs"),
    )
    return figures.crossJoin(F.broadcast(doubled))


def sample_per_group(df: DataFrame, keys: list[str], n: int, seed: int, order: list[str]) -> DataFrame:
    """At most n rows of each group, drawn by the MD5 of the seed and the ordering columns; the same rows each time."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(text.drawn_by(seed, *order), *order))
    return df.withColumn("factloom_rank", rank).where(F.col("factloom_rank") <= n).drop("factloom_rank")


def dominant_tracers(mapped: DataFrame, least_rows: int = 100, share: float = 0.7) -> DataFrame:
    """capability_id, tracer_id, n, share: tracers that give most of a capability's rows."""
    from pyspark.sql import Window

    counts = mapped.groupBy("capability_id", "tracer_id").agg(F.count("*").alias("n"))
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("capability_id")))
    return counts.where((F.col("n") >= least_rows) & (F.col("share") >= share))
