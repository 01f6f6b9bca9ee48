"""Station demand analytics on Spark: hourly flows, enrichment, forecasts."""

from stationflow.config import ForecastConfig
from stationflow.plans.forecast import clean, forecast, prepare, run_forecast, train_and_score
from stationflow.session import build_session, materialise, shared_dir
from stationflow.sources.readers import Sources, read_sources

__all__ = [
    "ForecastConfig", "Sources", "build_session", "clean", "forecast", "materialise", "prepare",
    "read_sources", "run_forecast", "shared_dir", "train_and_score",
]
