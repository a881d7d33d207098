"""The matching rules of each node type as data: named boolean Columns over a pair of property maps.

A rule is a function of (a, b), maps of string properties. The registry gives the rules of a type
in order; registering another type or rule extends the cascade without new operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import strings as S

Rule = Callable[[Column, Column], Column]

# Similarity of embeddings from which nodes of a type match.
VECTOR_THRESHOLDS = {"Person": 0.85, "Asset": 0.8, "Vehicle": 0.8, "Address": 0.75}
DEFAULT_THRESHOLD = 0.8
# Further types for which a threshold is documented.
EXTENDED_THRESHOLDS = {"Event": 0.8, "Task": 0.82, "Project": 0.83, "Note": 0.8}
#: No label matches below it.
LEAST_THRESHOLD = min(DEFAULT_THRESHOLD, *VECTOR_THRESHOLDS.values(), *EXTENDED_THRESHOLDS.values())
# Identifiers that are unique to an asset.
UNIQUE_FIELDS = ["license_plate", "vin", "part_number", "registration", "barcode", "product_code"]
# Words that are no brand.
BRAND_STOP_WORDS = ["the", "and", "or", "of", "for", "with", "model", "type", "size", "inch", "inches", "mm", "cm", "kg", "lb", "lbs"]


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _get(m: Column, key: str) -> Column:
    return S.blank_to_null(m[key])


def same(key: str) -> Rule:
    """Equal, ignoring case and outer space."""
    return lambda a, b: _false(F.lower(F.trim(_get(a, key))) == F.lower(F.trim(_get(b, key))))


def default_name(a: Column, b: Column) -> Column:
    x, y = (F.coalesce(_get(m, "name"), _get(m, "title")) for m in (a, b))
    return S.similar(x, y, 0.9)


def _full_name(m: Column) -> Column:
    parts = F.trim(F.concat_ws(" ", _get(m, "first_name"), _get(m, "last_name")))
    return F.coalesce(_get(m, "full_name"), _get(m, "name"), S.blank_to_null(parts))


def known(name: str) -> Column:
    """A column of properties that prepare() has made: what is derived from them is looked up in the plan, and how to derive it is no part of that."""
    m = F.col(name)
    m._known = True
    return m


def _or_prepared(key: str, derive: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: m[key] if vars(m).get("_known") else F.when(F.map_contains_key(m, key), m[key]).otherwise(derive(m))


full_name = _or_prepared("~full_name", _full_name)


def given(m: Column, key: str) -> Column:
    """A property; null if it is blank."""
    return _get(m, key)


def first_word(c: Column) -> Column:
    return F.element_at(F.split(F.trim(c), r"\s+"), 1)


def last_word(c: Column) -> Column:
    return F.element_at(F.split(F.trim(c), r"\s+"), -1)


def phone(a: Column, b: Column) -> Column:
    x, y = S.digits(_get(a, "phone")), S.digits(_get(b, "phone"))
    return _false((F.least(F.length(x), F.length(y)) >= 8) & (x.contains(y) | y.contains(x)))


def domain_and_name(a: Column, b: Column) -> Column:
    return _false((S.email_domain(_get(a, "email")) == S.email_domain(_get(b, "email"))) & S.similar(full_name(a), full_name(b), 0.8))


def person_name(a: Column, b: Column) -> Column:
    return S.similar(full_name(a), full_name(b), 0.9)


def last_name(m: Column) -> Column:
    return F.coalesce(_get(m, "last_name"), last_word(full_name(m)))


def initial(m: Column) -> Column:
    """First letter of the first name, if there is one."""
    return F.lower(F.substring(F.coalesce(_get(m, "first_name"), F.when(F.trim(full_name(m)).contains(" "), first_word(full_name(m)))), 1, 1))


def last_name_and_initial(a: Column, b: Column) -> Column:
    return S.similar(last_name(a), last_name(b), 0.9) & F.coalesce(initial(a) == initial(b), F.lit(True))


def unique_identifier(a: Column, b: Column) -> Column:
    return S.any_of([_false((S.alnum_upper(_get(a, k)) == S.alnum_upper(_get(b, k))) & (S.alnum_upper(_get(a, k)) != "")) for k in UNIQUE_FIELDS])


def prepare(props: Column, label: Column | None = None) -> Column:
    """The properties with what the rules derive from them, so that it is worked out once for each node and not for each pair."""
    own = F.coalesce(props, F.create_map().cast("map<string,string>"))
    derived = [F.lit("~brand"), _brand(own), F.lit("~model"), _model(own), F.lit("~full_name"), _full_name(own)]
    return F.map_concat(own, F.create_map(*derived, *([] if label is None else [F.lit("~label"), label])))


def _brand(m: Column) -> Column:
    """The first capitalised word that is no stop word over brand, make, manufacturer and name; else the first word of the name if longer than 2."""
    text = F.concat_ws(" ", *[_get(m, k) for k in ("brand", "make", "manufacturer", "name")])
    found = F.filter(F.split(text, r"\s+"), lambda w: w.rlike("^[A-Z]") & ~F.lower(w).isin(BRAND_STOP_WORDS))
    first = first_word(_get(m, "name"))
    return F.upper(F.coalesce(F.get(found, F.lit(0)), F.when(F.length(first) > 2, first)))


def _model(m: Column) -> Column:
    """The model; else the first later word of the name with a digit or of more than 4 characters; else its second word."""
    later = F.slice(F.split(F.trim(_get(m, "name")), r"\s+"), 2, 100)
    telling = F.filter(later, lambda w: w.rlike(r"\d") | (F.length(w) > 4))
    return F.coalesce(_get(m, "model"), F.get(telling, F.lit(0)), F.get(later, F.lit(0)))


brand, model = _or_prepared("~brand", _brand), _or_prepared("~model", _model)


def brand_and_model(a: Column, b: Column) -> Column:
    brands, models, names = [brand(m) for m in (a, b)], [model(m) for m in (a, b)], [_get(m, "name") for m in (a, b)]
    both = S.similar(*brands, 0.8) & S.similar(*models, 0.7)
    one = (brands[0].isNull() | brands[1].isNull()) & S.similar(*models, 0.7) & S.similar(*names, 0.6)
    crossed = _false(F.lower(names[0]).contains(F.lower(brands[1])) & F.lower(names[0]).contains(F.lower(models[1])))
    crossed |= _false(F.lower(names[1]).contains(F.lower(brands[0])) & F.lower(names[1]).contains(F.lower(models[0])))
    return _false(both | one | crossed)


def asset_name(a: Column, b: Column) -> Column:
    return S.similar(_get(a, "name"), _get(b, "name"), 0.85)


def address(m: Column) -> Column:
    return S.normalize_address(m["street"], m["city"], m["state"], F.coalesce(m["postalCode"], m["zip"]), m["country"])


def normalized_address(a: Column, b: Column) -> Column:
    """Equal, contained or similar as a whole. Both need a street: two empty addresses are no match."""
    x, y = address(a), address(b)
    named = S.present(a["street"]) & S.present(b["street"])
    return _false(named & ((x == y) | x.contains(y) | y.contains(x) | S.similar(x, y, 0.85))) & ~_other_number(a, b)


def _other_number(a: Column, b: Column) -> Column:
    x, y = (S.street_number(S.normalize_street(m["street"])) for m in (a, b))
    return _false(x != y)


def street(a: Column, b: Column) -> Column:
    x, y = S.normalize_street(a["street"]), S.normalize_street(b["street"])
    n, m = S.street_number(x), S.street_number(y)
    names = S.street_name(x), S.street_name(y)
    apart = F.when(n.isNull() | m.isNull(), S.similar(*names, 0.85)).otherwise((n == m) & S.similar(*names, 0.8))
    return _false((x != "") & (y != "") & ((x == y) | apart))


def city_state_zip(a: Column, b: Column) -> Column:
    """City and state, or ZIP and city; with equal ZIPs a city or a state may be 0.7 similar. The weaker signal of the address rules."""
    city = [S.normalize_city(m["city"]) for m in (a, b)]
    state = [S.normalize_state(m["state"]) for m in (a, b)]
    code = [S.zip5(F.coalesce(m["postalCode"], m["zip"])) for m in (a, b)]
    zips = (code[0] == code[1]) & (code[0] != "")
    cities = (city[0] == city[1]) & (city[0] != "")
    near_city = zips & (S.score_or_zero(*city) >= 0.7) & (city[0] != "") & (city[1] != "")
    states = (state[0] != "") & (state[1] != "") & ((state[0] == state[1]) | state[0].contains(state[1]) | state[1].contains(state[0]))
    near_state = zips & (cities | near_city) & (state[0] != "") & (state[1] != "") & (S.score_or_zero(*state) >= 0.7)
    return _false((cities & states) | (zips & cities) | near_city | near_state)


def coordinates(a: Column, b: Column, km: float = 0.1) -> Column:
    """Within km of each other. Not part of the registry's default rules."""
    lat, lon = [m["latitude"].cast("double") for m in (a, b)], [m["longitude"].cast("double") for m in (a, b)]
    return _false(S.haversine_km(lat[0], lon[0], lat[1], lon[1]) <= km)


PERSON: dict[str, Rule] = {
    "exact_email": same("email"),
    "phone": phone,
    "domain_and_name": domain_and_name,
    "full_name": person_name,
    "last_name_and_initial": last_name_and_initial,
}
ASSET: dict[str, Rule] = {
    "serial_number": same("serial_number"),
    "unique_identifier": unique_identifier,
    "brand_and_model": brand_and_model,
    "name": asset_name,
}
ADDRESS: dict[str, Rule] = {"normalized_address": normalized_address, "street": street}
DEFAULT: dict[str, Rule] = {"id": same("id"), "name": default_name}

REGISTRY: dict[str, dict[str, Rule]] = {
    "Address": ADDRESS,
    "Asset": ASSET,
    "Contact": PERSON,
    "Person": PERSON,
    "User": PERSON,
    "Vehicle": ASSET,
}


def rules(node_type: str) -> dict[str, Rule]:
    return REGISTRY.get(node_type, DEFAULT)


def threshold(node_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in (VECTOR_THRESHOLDS | EXTENDED_THRESHOLDS).items() for x in kv])
    return F.coalesce(known[node_type], F.lit(DEFAULT_THRESHOLD))


def fired(node_type: str, a: Column, b: Column) -> Column:
    """Names of the rules of a type that hold for a pair."""
    return F.array_compact(F.array(*[F.when(r(a, b), F.lit(k)) for k, r in rules(node_type).items()]))


def identity(a: Column, b: Column) -> Column:
    """id, email, phone or social-security number alike: checked before anything fuzzy."""
    ssn = [S.digits(_get(m, "ssn")) for m in (a, b)]
    return same("id")(a, b) | same("email")(a, b) | phone(a, b) | _false((ssn[0] == ssn[1]) & (ssn[0] != ""))


def matches(node_type: str, a: Column, b: Column, cosine: Column | None = None) -> Column:
    """Identity, any rule, or embeddings as near as the type asks for."""
    out = identity(a, b) | S.any_of([r(a, b) for r in rules(node_type).values()])
    if cosine is not None:
        out |= _false(cosine >= F.lit((VECTOR_THRESHOLDS | EXTENDED_THRESHOLDS).get(node_type, DEFAULT_THRESHOLD)))
    return out


# ---- Embedding texts -----------------------------------------------------------------------------

# Properties that make up the text that is embedded.
EMBEDDING_FIELDS = {
    "Address": ["street", "city", "state", "country", "postalCode", "notes"],
    "Asset": ["name", "description", "brand", "model", "serial_number", "category"],
    "Person": ["full_name", "name", "first_name", "last_name", "email", "phone", "title", "company"],
}
DEFAULT_FIELDS = ["name", "title", "description"]


def embedding_text(node_type: str, props: Column) -> Column:
    """The present fields of a type, joined by '. '."""
    return F.concat_ws(". ", *[S.blank_to_null(props[k]) for k in EMBEDDING_FIELDS.get(node_type, DEFAULT_FIELDS)])


# ---- Confidence ----------------------------------------------------------------------------------

AUTO_MERGE, AUTO_REJECT = 0.9, 0.3
# Weights of the rules in the confidence of a match; others weigh 0.5.
WEIGHTS = {"serial_number": 1.0, "unique_identifier": 0.95, "brand_and_model": 0.7, "name": 0.5}
# Properties that tell an asset from others.
IDENTIFYING = ["serial_number", "license_plate", "vin", "part_number", "barcode", "brand", "model", "name"]
# Names that say little.
GENERIC_NAMES = ["truck", "car", "vehicle", "bike", "item", "asset", "equipment", "tool", "part", "component"]


def rule_score(name: str, a: Column, b: Column) -> Column:
    if name in ("serial_number", "unique_identifier", "exact_email", "phone", "id"):
        return F.lit(1.0)
    if name == "brand_and_model":
        x = F.when(brand(a).isNull() | brand(b).isNull(), 0.3).otherwise(F.greatest(S.similarity(brand(a), brand(b)), F.lit(0.3)))
        y = F.when(model(a).isNull() | model(b).isNull(), 0.4).otherwise(F.greatest(S.similarity(model(a), model(b)), F.lit(0.4)))
        return (x + y) / 2
    if name == "name":
        missing = _get(a, "name").isNull() | _get(b, "name").isNull()
        return F.when(missing, 0.1).otherwise(0.8 * S.similarity(_get(a, "name"), _get(b, "name")))
    return F.lit(0.5)


def confidence(node_type: str, a: Column, b: Column, held: Column | None = None) -> Column:
    """Weighted mean score of the rules that hold, corrected for what the two nodes tell, within [0, 1]; 0 if none holds.

    held: the names from fired(), as a column.
    """
    held = fired(node_type, a, b) if held is None else held
    weights = {k: F.when(F.array_contains(held, k), WEIGHTS.get(k, 0.5)).otherwise(0.0) for k in rules(node_type)}
    weight = sum(weights.values(), F.lit(0.0))
    total = sum((F.when(F.array_contains(held, k), rule_score(k, a, b) * w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    base = total / weight
    known = [sum((S.present(m[k]).cast("int") for k in IDENTIFYING), F.lit(0)) for m in (a, b)]
    known = [F.coalesce(k, F.lit(0)) for k in known]
    change = F.when((known[0] >= 3) & (known[1] >= 3), 0.1).otherwise(0.0)
    change = change + F.when((known[0] <= 1) | (known[1] <= 1), -0.2).otherwise(0.0)
    generic = S.any_of([_false(F.lower(F.trim(m["name"])).isin(GENERIC_NAMES)) for m in (a, b)])
    change = change + F.when(generic, -0.15).otherwise(0.0)
    return F.when(F.size(held) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + change))).otherwise(0.0)


def decision(c: Column) -> Column:
    return F.when(c >= AUTO_MERGE, "auto_merge").when(c <= AUTO_REJECT, "auto_reject").otherwise("human_review")
