"""All registered queries."""

from checks import q_census, q_exposure, q_files, q_keys, q_panel, q_runs, q_series  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
