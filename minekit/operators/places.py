"""Place reconciliation against a geocoder and a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minekit.functions.text import (
    RATIO_CITY,
    RATIO_STATE,
    address_match,
    alias,
    norm_place,
    norm_place_scalar,
    part_score,
)
from minekit.operators.joins import fuzzy_lookup
from minekit.scale import blocks_for, settle

# Special spellings of places.
STATE_ALIASES = {"Hawaiʻi": "Hawaii"}
COUNTY_ALIASES = {"Hawaiʻi County": "Hawaii County", "Kauaʻi County": "Kauai County"}
CITY_ALIASES = {
    "Garden Lakes, City of Rome": "City of Rome",
    "Cairo, Georgia": "Cairo",
    "Hockessin, Delaware": "Hockessin",
}


def _best_part(name: str, text: str) -> Column:
    names = norm_place(name)
    second = F.get(names, F.lit(1))
    return F.greatest(part_score(F.get(names, F.lit(0)), text), F.when(second.isNotNull(), part_score(second, text)))


def place_scores(df: DataFrame, present: str = "coord_presence") -> DataFrame:
    """Scores of state, county or city, and address against the geocoded address; -1 without geocode."""
    here = F.coalesce(F.col(present), F.lit(False))
    score = lambda s: F.when(here, s).otherwise(-1)
    return df.withColumns(
        {
            "state_consistency": score(_best_part("state", "address_geopy")),
            "county_consistency": score(_best_part("city_or_county", "address_geopy")),
            "address_consistency": score(address_match("address", "address_geopy")),
        }
    )


ROWS = 10_000  # rows that a task scores


def reconcile_place(df: DataFrame, dim: DataFrame, *, state: str, county: str) -> DataFrame:
    """Geocoded place when the three scores add up to 1 or more, else the dictionary's place.

    ``dim`` lists (state, county) names. Names of accepted rows are blanked before the dictionary lookup, so
    only rows that failed take part in the typo search.
    """
    # a small file of many rows would be scored by one task; written once, the scores feed both lookups and the result
    scored = settle(place_scores(df.repartition(blocks_for(df.count(), ROWS))))
    total = F.col("state_consistency") + F.col("county_consistency") + F.col("address_consistency")
    scored = scored.withColumn("__ok", F.col("coord_presence") & (total >= 1))
    ok = F.coalesce(F.col("__ok"), F.lit(False))
    scored = scored.withColumn("__state_asked", F.when(~ok, F.col("state")))
    states = dim.select(F.col(state).alias("__s"))
    found = fuzzy_lookup(
        scored, states, name="__state_asked", dim_name="__s", ratio=RATIO_CITY, out="__dim_state",
        asked_as=lambda c: F.array(norm_place_scalar(c)), dim_as=norm_place_scalar,
    )
    found = found.withColumn("__asked", F.when(F.col("__dim_state").isNotNull(), F.col("city_or_county")))
    counties = dim.select(F.col(state).alias("__dim_state"), F.col(county).alias("__c"))
    found = fuzzy_lookup(
        found, counties, name="__asked", dim_name="__c", block=["__dim_state"], ratio=RATIO_STATE,
        out="__dim_county", asked_as=norm_place, dim_as=norm_place_scalar,
    )
    hit = F.col("__dim_county")
    spelled = (
        F.when(F.col("__dim_county_exact"), alias(hit, COUNTY_ALIASES))
        .when(F.contains(hit, F.lit("City of")), F.substring_index(hit, ",", 1))
        .otherwise(alias(F.concat(hit, F.lit(" County")), COUNTY_ALIASES))
    )
    city = F.coalesce("city_geopy", "town_geopy", "village_geopy")
    geo = lambda good, other=None: F.when(ok, good).otherwise(F.lit(None) if other is None else other)
    out = {
        "clean_state": F.upper(geo(F.col("state_geopy"), alias("__dim_state", STATE_ALIASES))),
        "clean_county": geo(F.coalesce("county_geopy", "suburb_geopy"), F.when(hit.isNotNull(), spelled)),
        "clean_city": geo(alias(city, CITY_ALIASES)),
        "clean_latitude": geo(F.col("latitude")),
        "clean_longitude": geo(F.col("longitude")),
        "location_importance": geo(F.col("importance_geopy")),
        "address_type": geo(F.col("addresstype_geopy")),
    }
    helpers = ["__ok", "__state_asked", "__dim_state", "__dim_state_exact", "__asked", "__dim_county", "__dim_county_exact"]
    return found.withColumns(out).drop(*helpers)
