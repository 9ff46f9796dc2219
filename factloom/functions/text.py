"""Text functions as column expressions; one pandas UDF, for Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words and patterns that the audit, the search and the source tiers are defined by.
LEGAL_SUFFIXES = ["co", "company", "corp", "corporation", "inc", "incorporated", "limited", "llc", "llp", "ltd", "plc", "private", "pvt"]
HEALTHCARE_DESCRIPTORS = [
    "advanced", "care", "center", "centre", "clinic", "college", "dental", "general", "health", "healthcare", "hospital", "hospitals", "institute", "medical",
    "multispeciality", "multispecialty", "research", "speciality", "specialty", "super",
]
GENERIC_ORG_PHRASES = [
    "care hospital", "city hospital", "dental clinic", "general hospital", "hospital", "india hospital", "medical center", "medical centre",
    "medical college", "medical college hospital", "multispeciality hospital", "multispecialty hospital",
]
LOCATION_END = r"(?:\b(?:based|located|situated|headquartered)\s+(?:at|in|near)|\b(?:hospital|clinic|centre|center|facility)\s+(?:at|in|near)|\b(?:services?|testing|treatment)\s+(?:at|in|near)|\b(?:operates?|established)\s+in)\s*$"
OWNERSHIP_VERBS = ["has", "have", "provides", "provide", "offers", "offer", "installed", "operates", "is", "runs", "features"]
CONTEXTUAL_CUES = r"\b(?:affiliated|association|directory|empanelled|network|listed|trained|training|worked|consultant|credential|graduate|degree|study|studied|insurance)\b"
BRANCH_CUES = r"\b(?:branch|branches|locations|clinics|network)\b"
NEGATION_BEFORE = r"\b(?:no|not|without|lacks?|lacking|unavailable|does not|do not|doesn't|don't|cannot|can't|never)\b"
THIRD_PARTY_BEFORE = r"\b(?:underwent|referred to|referral to|nearby|nearest|external|outsourced to|tie[- ]?up with|affiliated with)\b"
NEED_STOPWORDS = [
    "a", "an", "and", "around", "at", "care", "find", "for", "hospital", "hospitals", "i", "in", "looking", "me", "my", "near", "need", "needs", "please", "service", "services",
    "somewhere", "the", "want",
]
GOVERNMENT_DOMAINS = [".gov.in", ".nic.in", "pmjay.gov.in", "nabh.co", "mohfw.gov.in"]
WEAK_DIRECTORY_DOMAINS = ["facebook.com", "instagram.com", "justdial.com", "practo.com", "sulekha.com", "youtube.com"]
INSTITUTIONAL_ENDINGS = [".edu", ".ac.in", ".org"]
VERDICT_SIGNS = {"corroborated": "■", "claimed_only": "□", "insufficient_evidence": "–"}
VERDICT_NAMES = {"corroborated": "Corroborated", "claimed_only": "Claimed only", "insufficient_evidence": "Insufficient evidence"}


def normalize_text(value: object) -> str:
    """NFKD without combining marks, case-folded, `&amp;` as "and", letters and digits of ASCII with single spaces."""
    if not isinstance(value, str):
        return ""
    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).casefold()
    return " ".join("".join(c if c in _KEPT else " " for c in plain.replace("&amp;", " and ")).split())


_KEPT = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@F.pandas_udf(T.StringType())
def normalize(values: pd.Series) -> pd.Series:
    return values.map(normalize_text).astype("object")


def normalize_ascii(c: Column) -> Column:
    """The same as `normalize` for text of ASCII only, inside the JVM."""
    return spaced(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&amp;"), F.lit(" and ")))


def spaced(lower: Column) -> Column:
    """Letters and digits of ASCII of a text of small letters, with single spaces."""
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def squeeze(c: Column) -> Column:
    """The pre-flight form: trimmed, lower case, runs of white space as one space."""
    return strip(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def json_strings(c: Column, stripped: bool = True) -> Column:
    """The string items of a JSON array in text, without blank ones; anything else gives an empty array."""
    whole = F.when(c.rlike(r"(?s)^\s*\[.*\]\s*$"), F.try_parse_json(c))
    items = F.transform(F.coalesce(F.try_variant_get(whole, "$", "array<variant>"), F.expr("cast(array() as array<variant>)")), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    items = F.transform(items, strip) if stripped else items
    return F.filter(items, lambda x: x.isNotNull() & (strip(x) != ""))


def bullet_id(facility: Column, field: Column, position: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", facility.cast("string"), field, position.cast("string"), text), 256)


def cache_key(facility: Column, capability: Column, query: Column) -> Column:
    return F.sha2(F.concat_ws("|", facility.cast("string"), capability, query), 256)


def org_core(name: Column) -> Column:
    """Tokens of a normalised name that are neither a legal form nor a healthcare word."""
    stop = F.array(*[F.lit(w) for w in sorted({*LEGAL_SUFFIXES, *HEALTHCARE_DESCRIPTORS})])
    return F.filter(F.split(name, " "), lambda t: (t != "") & ~F.array_contains(stop, t))


def is_generic_org(name: Column) -> Column:
    return name.isin(GENERIC_ORG_PHRASES) | (F.size(org_core(name)) == 0)


def location_context(text: Column, start: Column) -> Column:
    """Whether the 55 characters before `start` (from 0) end in a phrase that names a place of business."""
    return F.substring(text, F.greatest(F.lit(0), start - 55) + 1, F.least(F.lit(55), start)).rlike(LOCATION_END)


def asserts_ownership(text: Column, start: Column, end: Column) -> Column:
    before = F.substring(text, F.greatest(F.lit(0), start - 35) + 1, F.least(F.lit(35), start))
    after = F.substring(text, end + 1, F.lit(55))
    verb = r"^\s*(?:" + "|".join(OWNERSHIP_VERBS) + r")\b"
    return ~before.rlike(CONTEXTUAL_CUES) & ~after.rlike(CONTEXTUAL_CUES) & (after.rlike(verb) | before.rlike(r"\b(?:by|at)\s*$"))


#: A word's border where only letters and digits of ASCII (and _) are of words; Java's own \b takes all letters.
ASCII_BORDER = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def named_org(original: Column, term: Column, ascii_words: bool = False) -> Column:
    """Whether a term of two words or more stands in the original text with every word capitalised. ascii_words: the term's words end at other letters than those of ASCII, as `normalize_ascii` makes them."""
    border = F.lit(ASCII_BORDER if ascii_words else r"\b")
    pattern = F.concat(F.lit("(?i)"), border, F.regexp_replace(term, " ", r"[\\W_]+"), border)
    words = F.filter(F.split(F.coalesce(F.regexp_substr(original, pattern), F.lit("")), "[^A-Za-z]+"), lambda w: w != "")
    return term.contains(" ") & (F.size(words) >= 2) & F.forall(words, lambda w: w.rlike("^[A-Z]"))


def blocked_before(prefix: Column) -> Column:
    """Whether negation or a third party stands in the characters before a hit."""
    return prefix.rlike("(?iu)" + NEGATION_BEFORE) | prefix.rlike("(?iu)" + THIRD_PARTY_BEFORE)


def need_terms(query_norm: Column, city_norm: Column) -> Column:
    """Content words of a normalised query: those before near, around or in; of three letters or more; no stop words, none of the city's."""
    before = F.split(query_norm, r"\b(?:near|around|in)\b", 2)[0]
    source = F.when(before == "", query_norm).otherwise(before)
    stop = F.array(*[F.lit(w) for w in NEED_STOPWORDS])
    return F.filter(F.split(source, " "), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t) & ~F.array_contains(F.split(F.coalesce(city_norm, F.lit("")), " "), t))


def highlight(text: Column, quote: Column) -> Column:
    """struct(before, match, after) around the first occurrence in any case; (text, "", "") without one."""
    at = F.when(F.coalesce(quote, F.lit("")) == "", 0).otherwise(F.position(F.lower(quote), F.lower(text)))
    n = F.length(quote)
    found = F.struct(F.substring(text, F.lit(1), at - 1).alias("before"), F.substring(text, at, n).alias("match"), F.substring(text, at + n, F.length(text)).alias("after"))
    return F.when(at > 0, found).otherwise(F.struct(text.alias("before"), F.lit("").alias("match"), F.lit("").alias("after")))


def domain_of(url: Column) -> Column:
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    place = F.lower(F.regexp_extract(full, r"^[^:]*://([^/?#]*)", 1))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.regexp_replace(place, r"^www\.", ""))


def source_tier(url: Column, official: Column) -> Column:
    domain, own = domain_of(url), domain_of(official)
    any_of = lambda tests: F.array_contains(F.array(*tests), True)
    return (
        F.when(domain == "", "D")
        .when((own != "") & ((domain == own) | domain.endswith(F.concat(F.lit("."), own))), "A_official_facility")
        .when(any_of([domain.contains(d) for d in GOVERNMENT_DOMAINS]), "A_government_or_registry")
        .when(any_of([domain.endswith(d) for d in INSTITUTIONAL_ENDINGS]), "B_institutional")
        .when(any_of([domain.contains(d) for d in WEAK_DIRECTORY_DOMAINS]), "D_directory_or_social")
        .otherwise("C_other_web")
    )


def json_items(c: Column) -> Column:
    """All items of a JSON array in text, as variants; null where the text is no JSON array."""
    return F.try_variant_get(F.when(c.rlike(r"(?s)^\s*\[.*\]\s*$"), F.try_parse_json(c)), "$", "array<variant>")


def _variant_text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(F.schema_of_variant(v) != "VOID", F.to_json(v))


def item_texts(c: Column) -> Column:
    """All items of a JSON array in text, whatever their kind, as text; JSON nulls stay nulls; null where the text is no JSON array."""
    return F.transform(json_items(c), _variant_text)


def url_list(c: Column) -> Column:
    """The items of a JSON array in text that say something, as text (numbers, and true as True; not 0, false, null and what is empty), or the one URL that the text is."""
    none = F.expr("cast(array() as array<string>)")
    said = F.transform(json_items(c), lambda v: F.when(F.schema_of_variant(v) == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "True")).otherwise(_variant_text(v)))
    told = F.filter(said, lambda x: x.isNotNull() & ~x.isin("", "[]", "{}") & ~x.rlike(r"^-?0+(?:\.0*)?$"))
    one = F.when(F.try_parse_json(c).isNull() & c.rlike("^https?://"), F.array(c)).otherwise(none)
    return F.coalesce(told, one, none)


def search_query(name: Column, city: Column, state: Column, capability: Column) -> Column:
    quoted = F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit('"'), name, F.lit('"')))
    parts = F.array(quoted, city, state, F.regexp_replace(capability, "_", " "), F.lit("official"))
    return F.concat_ws(" ", F.filter(parts, lambda p: p.isNotNull() & (F.trim(p) != "") & (F.lower(p) != "nan")))


def user_name(c: Column) -> Column:
    """White space collapsed, at most 120 characters; null if nothing is left."""
    return F.nullif(F.left(strip(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(120)), F.lit(""))


def first_json(c: Column) -> Column:
    """The JSON object between the first { and the last }, as variant."""
    return F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")))


def display_name(c: Column) -> Column:
    """The words of an id, each run of letters with a capital first and small letters after it ("x-ray_unit": "X-Ray Unit")."""
    runs = F.regexp_extract_all(F.lower(F.regexp_replace(c, "_", " ")), F.lit(r"(\p{L}+|\P{L}+)"))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substring(r, F.lit(2), F.length(r)))), "")


def verdict_label(c: Column) -> Column:
    pairs = [F.lit(x) for v, sign in VERDICT_SIGNS.items() for x in (v, f"{sign} {VERDICT_NAMES[v]}")]
    return F.coalesce(F.create_map(*pairs)[c], F.concat(F.lit("? "), c))


def valid_alias(c: Column) -> Column:
    return (F.length(c) >= 3) & c.rlike("[a-z]") & ~c.rlike("^[0-9]+$") & (F.size(F.split(c, " ")) <= 8)


def source_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 4, "2-4").otherwise("5+")


def drawn_by(seed: int, *columns: str) -> Column:
    """The order in which a seeded sample draws rows: MD5 of the seed and the columns as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))
