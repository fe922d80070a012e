"""tabwright: data preparation and data-quality checks as Spark DataFrame jobs."""

from tabwright.operators.dispatch import OPERATIONS, run_transform
from tabwright.session import build_session, scratch_dir

__all__ = ["OPERATIONS", "build_session", "run_transform", "scratch_dir"]
