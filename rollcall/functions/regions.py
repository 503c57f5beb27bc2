"""Regions as two-letter country codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollcall.operators.fuzzy import nearest_names

# Spellings that no code table has.
REGION_ALIASES = {
    "uk": "GB", "u.k.": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "northern ireland": "GB",
    "usa": "US", "u.s.a.": "US", "u.s.": "US", "united states of america": "US", "america": "US",
}
US_STATES = {
    "AL": "alabama", "AK": "alaska", "AZ": "arizona", "AR": "arkansas", "CA": "california", "CO": "colorado", "CT": "connecticut",
    "DE": "delaware", "DC": "district of columbia", "FL": "florida", "GA": "georgia", "HI": "hawaii", "ID": "idaho", "IL": "illinois",
    "IN": "indiana", "IA": "iowa", "KS": "kansas", "KY": "kentucky", "LA": "louisiana", "ME": "maine", "MD": "maryland",
    "MA": "massachusetts", "MI": "michigan", "MN": "minnesota", "MS": "mississippi", "MO": "missouri", "MT": "montana", "NE": "nebraska",
    "NV": "nevada", "NH": "new hampshire", "NJ": "new jersey", "NM": "new mexico", "NY": "new york", "NC": "north carolina",
    "ND": "north dakota", "OH": "ohio", "OK": "oklahoma", "OR": "oregon", "PA": "pennsylvania", "RI": "rhode island",
    "SC": "south carolina", "SD": "south dakota", "TN": "tennessee", "TX": "texas", "UT": "utah", "VT": "vermont", "VA": "virginia",
    "WA": "washington", "WV": "west virginia", "WI": "wisconsin", "WY": "wyoming",
}


def iso_countries(spark: SparkSession) -> DataFrame:
    """Countries as the Java locale tables have them: ``alpha2, alpha3, name``."""
    locale = spark._jvm.java.util.Locale
    english = locale.ENGLISH
    rows = []
    for code in locale.getISOCountries():
        country = locale("", code)
        rows.append((code, country.getISO3Country(), country.getDisplayCountry(english)))
    return spark.createDataFrame(rows, "alpha2 string, alpha3 string, name string")


def region_table(spark: SparkSession, countries: DataFrame | None = None, subdivisions: DataFrame | None = None) -> DataFrame:
    """``key, code``: every spelling of a region that is understood, in lower case.

    Where spellings clash, aliases win over country codes, those over codes of US states,
    then come three-letter codes, names of states and other subdivisions, and country names; of equal rank the least code wins.
    ``countries`` replaces the built-in ``alpha2, alpha3, name`` table; ``subdivisions`` has ``code`` (as ``CA-ON``) and ``name``.
    """
    countries = iso_countries(spark) if countries is None else countries
    fixed = [(k, v, 0) for k, v in REGION_ALIASES.items()]
    fixed += [(k.lower(), "US", 2) for k in US_STATES] + [(v, "US", 4) for v in US_STATES.values()]
    rows = spark.createDataFrame(fixed, "key string, code string, rank int")
    for column, rank in (("alpha2", 1), ("alpha3", 3), ("name", 5)):
        rows = rows.union(countries.select(F.lower(F.col(column)).alias("key"), F.col("alpha2").alias("code"), F.lit(rank).alias("rank")))
    if subdivisions is not None:
        rows = rows.union(subdivisions.select(F.lower("name").alias("key"), F.upper(F.substring_index("code", "-", 1)).alias("code"), F.lit(4).alias("rank")))
    best = rows.where("key IS NOT NULL AND code IS NOT NULL").groupBy("key").agg(F.min(F.struct("rank", "code")).alias("best"))
    return best.select("key", "best.code", "best.rank")


def region_key(region: Column) -> Column:
    return F.lower(F.trim(F.coalesce(region, F.lit(""))))


def with_region_code(df: DataFrame, column: str, out: str, table: DataFrame | None = None) -> DataFrame:
    """``df`` with the region's code in ``out``, empty text where it isn't understood.

    A caller's table may have any size; Spark chooses the join by it.
    """
    table = region_table(df.sparkSession) if table is None else table
    lookup = table.select(F.col("key").alias("__key"), F.col("code").alias("__code"))
    joined = df.withColumn("__own", region_key(F.col(column))).join(lookup, F.col("__own") == F.col("__key"), "left")
    return joined.withColumn(out, F.coalesce("__code", F.lit(""))).drop("__own", "__key", "__code")


def with_near_region_code(df: DataFrame, column: str, out: str, table: DataFrame | None = None) -> DataFrame:
    """As ``with_region_code``, with the nearest spelling of the table where a text has none, by the edits that its length forgives.

    Of spellings equally near the one of the higher rank counts (aliases before codes before names), then the least code.
    """
    table = region_table(df.sparkSession) if table is None else table
    exact = with_region_code(df, column, "__exact", table).withColumn("__text", region_key(F.col(column)))
    left = exact.where("__exact = '' AND __text <> ''").select("__text")
    order = [c for c in ("rank", "code") if c in table.columns]
    near = nearest_names(left, table, "__text", order=order).select(F.col("__text").alias("__own"), F.col("code").alias("__near"))
    joined = exact.join(near, (F.col("__text") == F.col("__own")) & (F.col("__exact") == ""), "left")
    return joined.withColumn(out, F.coalesce("__near", "__exact")).drop("__exact", "__text", "__own", "__near")


def regions_match(a: Column, b: Column) -> Column:
    """Codes match if they are equal or one is empty."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return (x == "") | (y == "") | (x == y)
