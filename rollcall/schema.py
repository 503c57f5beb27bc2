"""Entity tables: enumerations as small dimensions, and the schemas of the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Ids and names that stored data refers to.
SOURCE_TYPES = {
    1: "gleif", 2: "sec_edgar", 3: "companies_house", 4: "wikidata", 5: "wikidata_alias", 6: "gleif_other_name",
    7: "sec_ticker", 8: "wiki_anchor", 9: "paranames",
}
PEOPLE_TYPES = {
    1: "executive", 2: "politician", 3: "government", 4: "military", 5: "legal", 6: "professional", 7: "academic",
    8: "artist", 9: "media", 10: "athlete", 12: "journalist", 13: "activist", 15: "unknown",
}
ORGANIZATION_TYPES = {
    1: "business", 2: "fund", 3: "branch", 4: "nonprofit", 5: "ngo", 6: "foundation", 7: "trade_union", 8: "government",
    9: "international_org", 10: "political_party", 11: "educational", 12: "research", 13: "religious", 14: "sports",
    15: "media", 16: "healthcare", 17: "unknown",
}
SIMPLIFIED_LOCATION_TYPES = {1: "continent", 2: "country", 3: "subdivision", 4: "city", 5: "district", 6: "historic", 7: "other"}
LOCATION_TYPES = {  # id: (name, entity id of the class, simplified type)
    1: ("continent", 5107, 1), 2: ("country", 6256, 2), 3: ("sovereign_state", 3624078, 2), 4: ("dependent_territory", 161243, 2),
    5: ("us_state", 35657, 3), 6: ("us_county", 47168, 3), 7: ("state_of_australia", 5852411, 3), 8: ("state_of_germany", 1221156, 3),
    9: ("state_of_india", 131541, 3), 10: ("province", 34876, 3), 11: ("region", 82794, 3), 12: ("county", 28575, 3),
    13: ("department_france", 6465, 3), 14: ("prefecture_japan", 50337, 3), 15: ("canton_switzerland", 23058, 3),
    16: ("autonomous_community_spain", 10742, 3), 17: ("voivodeship_poland", 150093, 3), 18: ("oblast_russia", 835714, 3),
    19: ("city", 515, 4), 20: ("big_city", 1549591, 4), 21: ("capital", 5119, 4), 22: ("town", 3957, 4), 23: ("municipality", 15284, 4),
    24: ("commune_france", 484170, 4), 25: ("municipality_germany", 262166, 4), 26: ("municipality_japan", 1054813, 4),
    27: ("village", 532, 4), 28: ("hamlet", 5084, 4), 29: ("district", 149621, 5), 30: ("borough", 5765681, 5),
    31: ("neighborhood", 123705, 5), 32: ("ward", 12813115, 5), 33: ("former_country", 3024240, 6),
    34: ("ancient_civilization", 28171280, 6), 35: ("historic_territory", 1620908, 6), 36: ("other", None, 7),
}
SCHEMA_VERSION = "6"

#: Values that an unknown name maps to.
DEFAULT_SOURCE, DEFAULT_ORGANIZATION_TYPE, DEFAULT_PERSON_TYPE, DEFAULT_LOCATION_TYPE = 4, 17, 15, 36
SOURCE_SYNONYMS = {"wikipedia": "wikidata"}


def _ids(name: Column, ids: dict[str, int], default: int) -> Column:
    """The id of a name; null and names that are not known give the default."""
    known = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), F.lit(default)).cast("long")


def source_id(name: Column) -> Column:
    ids = {v: k for k, v in SOURCE_TYPES.items()}
    return _ids(name, ids | {k: ids[v] for k, v in SOURCE_SYNONYMS.items()}, DEFAULT_SOURCE)


def organization_type_id(name: Column) -> Column:
    return _ids(name, {v: k for k, v in ORGANIZATION_TYPES.items()}, DEFAULT_ORGANIZATION_TYPE)


def person_type_id(name: Column) -> Column:
    return _ids(name, {v: k for k, v in PEOPLE_TYPES.items()}, DEFAULT_PERSON_TYPE)


def location_type_id(name: Column) -> Column:
    return _ids(name, {v[0]: k for k, v in LOCATION_TYPES.items()}, DEFAULT_LOCATION_TYPE)


def _fields(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # type: ignore[return-value]


ROLES = "id long, qid long, name string, name_normalized string, source_id long, source_identifier string, record string, canon_id long, canon_size long"
LOCATIONS = (
    "id long, qid long, name string, name_normalized string, source_id long, source_identifier string, parent_ids array<long>, "
    "location_type_id long, record string, from_date string, to_date string, canon_id long, canon_size long"
)
ORGANIZATIONS = (
    "id long, qid long, name string, name_normalized string, source_id long, source_identifier string, region_id long, entity_type_id long, "
    "from_date string, to_date string, record string, canon_id long, canon_size long, alias_source_id long, alias_source_identifier string"
)
PEOPLE = (
    "id long, qid long, name string, name_normalized string, source_id long, source_identifier string, country_id long, person_type_id long, "
    "known_for_role_id long, known_for_org_id long, from_date string, to_date string, birth_date string, death_date string, record string, "
    "canon_id long, canon_size long"
)
#: What makes two rows of a table the same row.  Nulls compare as equal.
KEYS = {
    "roles": ["name_normalized", "source_id"],
    "locations": ["source_identifier", "source_id"],
    "organizations": ["source_identifier", "source_id", "alias_source_id", "name_normalized"],
    "people": ["source_identifier", "source_id", "known_for_role_id", "known_for_org_id", "from_date"],
}
TABLES = {"roles": ROLES, "locations": LOCATIONS, "organizations": ORGANIZATIONS, "people": PEOPLE}


def dimension(spark: SparkSession, values: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(list(values.items()), "id long, name string")


def location_types(spark: SparkSession) -> DataFrame:
    rows = [(i, name, qid, simple, SIMPLIFIED_LOCATION_TYPES[simple]) for i, (name, qid, simple) in LOCATION_TYPES.items()]
    return spark.createDataFrame(rows, "id long, name string, qid long, simplified_id long, simplified string")


def empty_database(spark: SparkSession) -> dict[str, DataFrame]:
    """All tables of a new database: the dimensions filled, the facts empty."""
    return {
        "source_types": dimension(spark, SOURCE_TYPES), "people_types": dimension(spark, PEOPLE_TYPES),
        "organization_types": dimension(spark, ORGANIZATION_TYPES), "simplified_location_types": dimension(spark, SIMPLIFIED_LOCATION_TYPES),
        "location_types": location_types(spark), "db_info": spark.createDataFrame([("schema_version", SCHEMA_VERSION)], "key string, value string"),
        **{name: spark.createDataFrame([], fields) for name, fields in TABLES.items()},
    }
