"""A registrant's submissions document: who it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Names of months by the first two digits of a fiscal year's end.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
IDENTITY = "struct<cik:string,name:string,tickers:array<string>,exchanges:array<string>,sic:string,sicDescription:string,fiscalYearEnd:string,stateOfIncorporation:string,stateOfIncorporationDescription:string,website:string,investorWebsite:string,category:string,ein:string,phone:string,entityType:string>"


def profiles(payloads: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Keys, cik (padded), legal_name, ticker (the first, else the cik), exchange (the first), industry, sic, fiscal_year_end (month), website,
    investor_website, category, description, and how many tickers there are. Blank texts are null; a text that is no JSON has no row."""
    d = payloads.select(*keys, F.from_json(F.col(payload), IDENTITY).alias("d")).filter("d IS NOT NULL AND (d.cik IS NOT NULL OR d.name IS NOT NULL)")
    said = lambda c: F.nullif(F.trim(F.col(f"d.{c}")), F.lit(""))
    cik = T.cik(F.col("d.cik"))
    end = said("fiscalYearEnd")
    month = F.get(F.array(*map(F.lit, MONTHS)), F.substring(end, 1, 2).try_cast("int") - 1)
    parts = F.concat_ws(". ", F.concat(F.lit("SIC: "), said("sicDescription")), F.concat(F.lit("Incorporated in: "), said("stateOfIncorporationDescription")), F.concat(F.lit("Entity type: "), said("entityType")))
    return d.select(
        *keys, cik.alias("cik"), F.coalesce("d.name", F.lit("")).alias("legal_name"), F.coalesce(F.get("d.tickers", 0), cik).alias("ticker"), F.get("d.exchanges", 0).alias("exchange"), said("sicDescription").alias("industry"), said("sic").alias("sic"),
        F.when(F.length(end) == 4, F.coalesce(month, end)).alias("fiscal_year_end"), said("website").alias("website"), said("investorWebsite").alias("investor_website"), said("category").alias("category"), F.nullif(parts, F.lit("")).alias("description"), F.coalesce(F.size("d.tickers"), F.lit(0)).alias("n_tickers"),
    )
