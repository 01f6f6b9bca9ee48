"""Run configuration, passed explicitly to every operator that needs it."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

# The stations that are modelled.
STATIONS = ("Centraal Station", "Station Zuid", "Station Bijlmer ArenA")

# Trips per hour from which a station counts as crowded.
CROWDING_LINE = {
    "Centraal Station": 8845,
    "Station Zuid": 5428,
    "Station Bijlmer ArenA": 3562,
}

# Published switch name -> (attribute, type).
PUBLISHED_KEYS = {
    "IncludeInstagramEvents": ("include_social_events", bool),
    "IncludeTicketmasterEvents": ("include_ticketed_events", bool),
    "UseNormalizedVisitors": ("use_attendance", bool),
    "UseEventStationDistance": ("use_distance", bool),
    "UseTimeOfEvents": ("use_event_time", bool),
    "MaxHoursBeforeEvent": ("hours_before", int),
    "MaxMinutesBeforeEvent": ("minutes_before", int),
    "MaxHoursAfterEvent": ("hours_after", int),
    "MaxMinutesAfterEvent": ("minutes_after", int),
    "UseCOVIDStringency": ("use_stringency", bool),
    "UseCOVIDMeasures": ("use_measures", bool),
    "UseCOVIDCases": ("use_cases", bool),
    "UseCOVIDDeaths": ("use_deaths", bool),
}

# Features a user may select.
SELECTABLE_FEATURES = (
    "year", "month", "weekday", "holiday", "vacation",
    "temperature", "wind_speed", "precipitation_h", "global_radiation",
    "check_ins_week_ago", "check_outs_week_ago",
)
# Always part of the model input.
BASE_FEATURES = ("hour", "planned_event")


@dataclass(frozen=True)
class ForecastConfig:
    include_social_events: bool = True
    include_ticketed_events: bool = True
    use_attendance: bool = True
    use_distance: bool = True
    use_event_time: bool = True
    hours_before: int = 3
    minutes_before: int = 0
    hours_after: int = 3
    minutes_after: int = 0
    use_stringency: bool = True
    use_measures: bool = True
    use_cases: bool = True
    use_deaths: bool = True

    stations: tuple[str, ...] = STATIONS
    # (station, latitude, longitude) of stations beside the published ones.
    station_points: tuple[tuple[str, float, float], ...] = ()
    features: tuple[str, ...] = field(default=SELECTABLE_FEATURES)
    zone: str = "Europe/Amsterdam"
    country: str = "Netherlands"
    geo_id: str = "NL"
    country_code: str = "NLD"
    weather_station: str = "240"
    first_event_year: int = 2019

    cover_show: bool = False
    roll_midnight: bool = False
    ticket_zone_mode: str = "local"  # or "as_is"
    weather_hour_mode: str = "local"  # or "utc_hour"
    forecast_shift_hours: int = 1
    forecast_fill_hours: int = 11
    stringency_horizon_days: int = 13
    vacation_shift_days: int = 1
    week_ago_fallback: str = "same_week"  # or "previous_week"
    case_date_format: str = "dd/MM/yyyy"

    # Forest settings.
    num_trees: int = 100
    max_depth: int = 30  # the most that pyspark.ml grows
    max_bins: int = 256  # candidate splits per feature are taken from so many quantiles
    # (station, trees, depth) where a station has its own.
    station_forests: tuple[tuple[str, int, int], ...] = ()
    seed: int = 1

    @classmethod
    def from_mapping(cls, settings: dict) -> "ForecastConfig":
        """Build from published key names; unknown keys are an error."""
        unknown = set(settings) - set(PUBLISHED_KEYS)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        values = {}
        for key, raw in settings.items():
            attribute, kind = PUBLISHED_KEYS[key]
            if kind is bool and isinstance(raw, str):
                raw = raw.strip().lower() in ("yes", "true", "on", "1")
            values[attribute] = kind(raw)
        return cls(**values)

    def published(self) -> dict:
        """The 13 published settings under their public names."""
        return {key: getattr(self, attr) for key, (attr, _) in PUBLISHED_KEYS.items()}

    def forest_of(self, station: str) -> tuple[int, int]:
        """Trees and depth of a station's forests."""
        own = {name: (trees, depth) for name, trees, depth in self.station_forests}
        return own.get(station, (self.num_trees, self.max_depth))

    def with_(self, **changes) -> "ForecastConfig":
        return replace(self, **changes)

    def model_features(self, measures: tuple[str, ...] = ()) -> list[str]:
        """Feature columns of the model: chosen, always-on and switched-on ones."""
        chosen = [f.replace("check-", "check_") for f in self.features]
        for name, on in (("stringency", self.use_stringency), ("cases", self.use_cases),
                         ("deaths", self.use_deaths)):
            if on:
                chosen.append(name)
        if self.use_measures:
            chosen.extend(measures)
        return list(dict.fromkeys([*chosen, *BASE_FEATURES]))


assert {a for a, _ in PUBLISHED_KEYS.values()} <= {f.name for f in fields(ForecastConfig)}
__all__ = ["BASE_FEATURES", "CROWDING_LINE", "ForecastConfig", "PUBLISHED_KEYS",
           "SELECTABLE_FEATURES", "STATIONS"]
