"""Statistical analyses over sufficient statistics that Spark aggregates."""

from . import association, basic, learning, regression, reliability, survival  # noqa: F401
from .result import ANALYSES, AnalysisError, as_rows, run_analysis

__all__ = ["ANALYSES", "AnalysisError", "as_rows", "run_analysis"]
