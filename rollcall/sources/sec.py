"""Securities filings: company submissions, tickers, form indexes and insiders' forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollcall.functions import names
from rollcall.sources.ranges import zip_members
from rollcall.sources.records import company, person, text

# Codes and types of the filings.
FUND_CODES = ("6722", "6726", "6732", "6733", "6792", "6794", "6795", "6798", "6799")
ORGANIZATION_TYPES = ("operating", "foreign-private-issuer")

_SUBMISSION = (
    "cik string, name string, entityType string, sic string, sicDescription string, stateOfIncorporation string, fiscalYearEnd string, exchanges array<string>, "
    "addresses struct<business:struct<street1:string,city:string,stateOrCountry:string,zipCode:string>>, filings struct<recent:struct<filingDate:array<string>>>"
)
_TICKER = "map<string,struct<cik_str:string,ticker:string,title:string>>"
_FORM = (
    "issuer struct<issuerCik:string,issuerName:string,issuerTradingSymbol:string>, periodOfReport string, reportingOwner array<struct<"
    "reportingOwnerId:struct<rptOwnerCik:string,rptOwnerName:string>,"
    "reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,officerTitle:string,isTenPercentOwner:string>>>"
)


def tickers(objects: DataFrame, column: str = "value") -> DataFrame:
    """``cik, ticker, title`` of the ticker file's text."""
    rows = objects.select(F.explode(F.map_values(F.from_json(column, _TICKER))).alias("x"))
    return rows.select(names.zero_filled(F.col("x.cik_str")).alias("cik"), F.col("x.ticker").alias("ticker"), F.col("x.title").alias("title"))


def ticker_companies(objects: DataFrame, column: str = "value") -> DataFrame:
    rows = tickers(objects, column)
    return company(rows, "sec_edgar", F.to_json(F.struct("cik", "ticker", "title")), name=F.col("title"), source_id=F.col("cik"), region=F.lit("US"), entity_type=F.lit("unknown"))


def parse_submissions(objects: DataFrame, lookup: DataFrame | None = None, column: str = "value") -> DataFrame:
    """Organisations among the submissions: those of a company type, with a ticker, or with an industry code."""
    rows = objects.select(F.from_json(column, _SUBMISSION).alias("x")).select("x.*").where(text("name").isNotNull())
    rows = rows.withColumn("cik", names.zero_filled(F.coalesce("cik", F.lit(""))))
    if lookup is None:
        rows = rows.withColumn("ticker", F.lit(""))
    else:
        own = lookup.groupBy("cik").agg(F.max("ticker").alias("ticker"))
        rows = rows.join(own, "cik", "left").withColumn("ticker", F.coalesce("ticker", F.lit("")))
    kind, sic = F.lower(F.coalesce("entityType", F.lit(""))), F.coalesce("sic", F.lit(""))
    kept = rows.where(kind.isin(*ORGANIZATION_TYPES) | (F.col("ticker") != "") | (sic != ""))
    since = F.substring(F.try_element_at("filings.recent.filingDate", F.lit(-1)), 1, 10)
    business = F.col("addresses.business")
    record = F.to_json(F.struct(
        "cik", F.trim("name").alias("name"), sic.alias("sic"), F.coalesce("sicDescription", F.lit("")).alias("sic_description"), kind.alias("entity_type"), F.col("stateOfIncorporation").alias("state_of_incorporation"),
        F.col("fiscalYearEnd").alias("fiscal_year_end"), "ticker", F.coalesce(F.get("exchanges", F.lit(0)), F.lit("")).alias("exchange"),
        F.struct(business["street1"].alias("street"), business["city"].alias("city"), business["stateOrCountry"].alias("state"), business["zipCode"].alias("zip")).alias("business_address"), since.alias("first_filing_date"),
    ))
    entity = F.when(sic.isin(*FUND_CODES), "fund").when(kind == "", "unknown").otherwise("business")
    return company(kept, "sec_edgar", record, name=F.trim("name"), source_id=F.col("cik"), region=F.coalesce(business["stateOrCountry"], F.lit("US")), entity_type=entity, from_date=F.when(F.length(since) == 10, since))


def read_submissions(spark: SparkSession, path: str, lookup: DataFrame | None = None) -> DataFrame:
    """The ``CIK*.json`` members of submission archives."""
    return parse_submissions(zip_members(spark, path, "CIK*.json"), lookup)


def parse_form_index(lines: DataFrame, column: str = "value") -> DataFrame:
    """Form-4 lines of a quarterly index: ``form_type, company_name, cik, date_filed, file_path``."""
    parts = F.split(F.trim(column), r"\s+")
    rows = lines.where(F.startswith(F.col(column), F.lit("4 "))).select(parts.alias("p"))
    is_cik = lambda x, i: F.when((i > 0) & F.rlike(x, F.lit("^[0-9]{6,}$")), i)
    placed = rows.withColumn("at", F.array_min(F.array_compact(F.transform("p", is_cik)))).where("at IS NOT NULL AND size(p) > at + 2")
    return placed.select(
        F.get("p", F.lit(0)).alias("form_type"), F.array_join(F.slice("p", F.lit(2), F.col("at") - 1), " ").alias("company_name"), names.zero_filled(F.get("p", F.col("at"))).alias("cik"),
        F.get("p", F.col("at") + 1).alias("date_filed"), F.get("p", F.col("at") + 2).alias("file_path"),
    )


def parse_insider_forms(filings: DataFrame, column: str = "value") -> DataFrame:
    """A person record for each reporting owner with a relation to the issuer."""
    xml = F.regexp_extract(column, r"(?s)(<ownershipDocument>.*</ownershipDocument>)", 1)
    docs = filings.select(xml.alias("xml")).where("xml <> ''").select(F.from_xml("xml", _FORM).alias("d")).select("d.*")
    owners = docs.select("issuer", "periodOfReport", F.explode("reportingOwner").alias("o"))
    yes = lambda c: F.coalesce(F.col(f"o.reportingOwnerRelationship.{c}") == "1", F.lit(False))
    rows = owners.select(
        names.without_zeros(F.col("issuer.issuerCik")).alias("issuer_cik"), F.col("issuer.issuerName").alias("issuer_name"), F.coalesce("issuer.issuerTradingSymbol", F.lit("")).alias("issuer_ticker"),
        names.without_zeros(F.col("o.reportingOwnerId.rptOwnerCik")).alias("owner_cik"), F.col("o.reportingOwnerId.rptOwnerName").alias("owner_name"), yes("isDirector").alias("is_director"),
        yes("isOfficer").alias("is_officer"), F.coalesce("o.reportingOwnerRelationship.officerTitle", F.lit("")).alias("officer_title"), yes("isTenPercentOwner").alias("is_owner"), F.col("periodOfReport").alias("period_of_report"),
    ).where("issuer_cik <> '' AND issuer_name <> '' AND owner_cik <> '' AND owner_name <> '' AND (is_director OR is_officer OR is_owner)")
    record = F.to_json(F.struct("owner_cik", "issuer_cik", "issuer_name", "issuer_ticker", "is_director", "is_officer", "officer_title", "period_of_report"))
    return person(
        rows, "sec_edgar", record, name=names.title_case(F.col("owner_name")), source_id=F.concat_ws("_", "owner_cik", "issuer_cik"), country=F.lit("US"), person_type=F.lit("executive"),
        known_for_role=names.insider_role(F.col("is_director"), F.col("is_officer"), F.col("officer_title"), F.col("is_owner")), known_for_org_name=F.col("issuer_name"), from_date=F.col("period_of_report"),
    )
