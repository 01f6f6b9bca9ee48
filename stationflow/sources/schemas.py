"""Schemas of the raw files, as Spark DDL."""

from __future__ import annotations

from stationflow.operators.weather import OBSERVED, PREDICTED

# Columns of the raw sources.
ORIGIN_TRIPS = (
    "Datum string, `UurgroepOmschrijving (van vertrek)` string, VertrekHalteCode string, "
    "VertrekHalteNaam string, AantalReizen string")
DESTINATION_TRIPS = (
    "Datum string, `UurgroepOmschrijving (van aankomst)` string, AankomstHalteCode string, "
    "AankomstHalteNaam string, AantalReizen string")
OBSERVED_WEATHER = "date string, hour int, station_code string, " + ", ".join(f"{c} double" for c in OBSERVED)
PREDICTED_WEATHER = "loc string, tijd bigint, offset string, " + ", ".join(f"{c} string" for c in PREDICTED)
EVENT_SHEET = (
    "ord bigint, Datum string, Locatie string, `Naam evenement` string, `Start show` string, "
    "`Einde show` string, `Aantal bezoekers` double")
SOCIAL_EVENTS = "ord bigint, venue string, event_date string"
TICKETED_EVENTS = "ord bigint, name string, venue string, datetime string"
MEASURES = "Country string, Response_measure string, date_start date, date_end date"
CASES = "dateRep string, geoId string, cases double, deaths double"
SCHOOL_YEARS = """
content array<struct<
  schoolyear: string,
  vacations: array<struct<
    type: string,
    regions: array<struct<region: string, startdate: string, enddate: string>>>>>>
"""
