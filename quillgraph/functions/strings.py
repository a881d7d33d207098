"""String similarity and the normalisers of names, identifiers and addresses, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance of the lower-cased strings / longer length; 0 if either is null, 1 if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    s = F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longest)
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(s)


def similar(a: Column, b: Column, least: float = 0.8) -> Column:
    """Equal, or similarity of `least` at least; false for null. The three-argument distance stops early."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.coalesce((a == b) | ((longest > 0) & (similarity(a, b) >= F.lit(least) - 1e-12)), F.lit(False))


def score_or_zero(a: Column, b: Column) -> Column:
    """similarity, but 0 if either is blank (1 if equal)."""
    return F.coalesce(F.when(a == b, 1.0).when(present(a) & present(b), similarity(a, b)), F.lit(0.0))


def trigrams(c: Column) -> Column:
    """Distinct three-character pieces; empty for shorter strings."""
    n = F.length(c)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(c, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def trigram_jaccard(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def alnum_upper(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def email_domain(c: Column) -> Column:
    return F.when(F.instr(c, "@") > 0, F.lower(F.substring_index(c, "@", -1)))


# Street suffixes, in the order in which they are applied.
STREET_SUFFIXES = [
    ("st", "street"),
    ("ave", "avenue"),
    ("rd", "road"),
    ("blvd", "boulevard"),
    ("ln", "lane"),
    ("dr", "drive"),
    ("ct", "court"),
    ("pl", "place"),
    ("terr", "terrace"),
    ("pkwy", "parkway"),
    ("hwy", "highway"),
]
# Compass words and their short forms.
DIRECTIONS = {"north": "n", "northeast": "ne", "northwest": "nw", "south": "s", "southeast": "se", "southwest": "sw", "east": "e", "west": "w"}
# Other names of cities.
CITY_ALIASES = {
    "san francisco": ["san fran", "sf", "san francisco ca"],
    "new york": ["nyc", "new york city", "new york ny", "ny new york"],
    "los angeles": ["la", "los angeles ca"],
    "chicago": ["chi", "chitown", "chicago il"],
    "philadelphia": ["philly", "philadelphia pa"],
    "san diego": ["san diego ca"],
    "san jose": ["san jose ca"],
    "austin": ["austin tx"],
    "miami": ["miami fl"],
    "seattle": ["seattle wa"],
    "portland": ["portland or", "portland me"],
    "washington dc": ["washington district of columbia"],
}
# States and territories, and their abbreviations.
STATES = {
    "alabama": "AL",
    "alaska": "AK",
    "american samoa": "AS",
    "arizona": "AZ",
    "arkansas": "AR",
    "california": "CA",
    "colorado": "CO",
    "connecticut": "CT",
    "delaware": "DE",
    "district of columbia": "DC",
    "federated states of micronesia": "FM",
    "florida": "FL",
    "georgia": "GA",
    "guam": "GU",
    "hawaii": "HI",
    "idaho": "ID",
    "illinois": "IL",
    "indiana": "IN",
    "iowa": "IA",
    "kansas": "KS",
    "kentucky": "KY",
    "louisiana": "LA",
    "maine": "ME",
    "marshall islands": "MH",
    "maryland": "MD",
    "massachusetts": "MA",
    "michigan": "MI",
    "minnesota": "MN",
    "mississippi": "MS",
    "missouri": "MO",
    "montana": "MT",
    "nebraska": "NE",
    "nevada": "NV",
    "new hampshire": "NH",
    "new jersey": "NJ",
    "new mexico": "NM",
    "new york": "NY",
    "north carolina": "NC",
    "north dakota": "ND",
    "northern mariana islands": "MP",
    "ohio": "OH",
    "oklahoma": "OK",
    "oregon": "OR",
    "palau": "PW",
    "pennsylvania": "PA",
    "puerto rico": "PR",
    "rhode island": "RI",
    "south carolina": "SC",
    "south dakota": "SD",
    "tennessee": "TN",
    "texas": "TX",
    "utah": "UT",
    "vermont": "VT",
    "virgin islands": "VI",
    "u.s. virgin islands": "VI",
    "virginia": "VA",
    "washington": "WA",
    "west virginia": "WV",
    "wisconsin": "WI",
    "wyoming": "WY",
}
# Other short forms of states.
STATE_SHORT = {
    "CA": ["calif", "cal"],
    "CO": ["colo", "col"],
    "CT": ["conn"],
    "FL": ["fla"],
    "IL": ["ill"],
    "MA": ["mass"],
    "MI": ["mich"],
    "MN": ["minn"],
    "NE": ["nebr", "neb"],
    "OR": ["ore"],
    "PA": ["penn", "penna"],
    "TN": ["tenn"],
    "TX": ["tex"],
    "VA": ["virg"],
    "WA": ["wash"],
    "WI": ["wisc", "wis"],
    "WV": ["wva", "w.va.", "w va"],
}
# Other names of countries.
COUNTRIES = {
    "usa": ["united states", "united states of america", "u.s.", "us", "usa", "u.s.a."],
    "uk": ["united kingdom", "u.k.", "uk", "great britain", "gb", "g.b."],
    "canada": ["canada", "ca", "can"],
    "australia": ["australia", "aus", "au"],
    "germany": ["germany", "de", "deu", "germany, federal republic of"],
    "france": ["france", "fr", "fra"],
    "spain": ["spain", "es", "esp"],
    "italy": ["italy", "it", "ita"],
    "japan": ["japan", "jp", "jpn"],
    "china": ["china", "cn", "chn"],
}


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_street(c: Column) -> Column:
    """Lower case without punctuation, suffixes and then compass words shortened. Two-word compass names stay two letters."""
    s = _squeeze(F.regexp_replace(F.lower(c), "[,.]", ""))
    for short, long in STREET_SUFFIXES:
        s = F.regexp_replace(s, rf"\b{long}\b", short)
    for word, short in DIRECTIONS.items():
        s = F.regexp_replace(s, rf"\b{word}\b", short)
    return F.coalesce(_squeeze(F.regexp_replace(s, r"[^\w\s]", "")), F.lit(""))


def normalize_city(c: Column) -> Column:
    """Lower case without punctuation and a trailing state after a comma; saint, fort, mount and compass words shortened; aliases resolved."""
    s = F.regexp_replace(F.lower(F.trim(c)), r",\s*[a-z]{2}$", "")
    s = _squeeze(F.regexp_replace(s, r"[^\w\s]", ""))
    alias = _lookup({a: city for city, others in CITY_ALIASES.items() for a in others})
    for word, short in (("saint", "st"), ("fort", "ft"), ("mount", "mt")):
        s = F.regexp_replace(s, rf"\b{word}\b", short)
    for word in ("north", "south", "east", "west"):
        s = F.regexp_replace(s, rf"\b{word}\b", word[0])
    return F.coalesce(alias[s], s, F.lit(""))


def normalize_state(c: Column) -> Column:
    """The two-letter code of a state in any spelling; anything else trimmed and in upper case."""
    s = F.lower(F.trim(c))
    known = _lookup(STATES | {a: code for code, others in STATE_SHORT.items() for a in others})
    return F.coalesce(known[s], known[F.regexp_replace(s, r"\.$", "")], F.upper(F.trim(c)), F.lit(""))


def normalize_country(c: Column) -> Column:
    s = F.lower(F.trim(c))
    known = _lookup({a: name for name, others in COUNTRIES.items() for a in others})
    return F.when(present(c), F.coalesce(known[s], s)).otherwise("usa")


def zip5(c: Column) -> Column:
    return F.coalesce(F.substring(digits(c), 1, 5), F.lit(""))


def normalize_address(street: Column, city: Column, state: Column, postal: Column, country: Column) -> Column:
    """street, city state zip, country: lower case, without empty parts."""
    middle = F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (normalize_city(city), normalize_state(state), zip5(postal))])
    return F.lower(F.concat_ws(", ", *[F.nullif(x, F.lit("")) for x in (normalize_street(street), middle, normalize_country(country))]))


def street_number(street: Column) -> Column:
    """The leading number of a normalised street (the first of a range), or null."""
    return F.nullif(F.regexp_extract(street, r"^(\d+[a-z]?(?:\s\d+/\d+)?)(?:-\d+[a-z]?)?\s", 1), F.lit(""))


def street_name(street: Column) -> Column:
    return F.trim(F.regexp_replace(street, r"^\d+[a-z]?(?:\s\d+/\d+)?(?:-\d+[a-z]?)?\s+", ""))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
