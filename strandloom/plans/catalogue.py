"""All registered queries over the driver's tables, with the SQL that gives the same rows."""

from . import q_benchmark, q_calibrate, q_functions, q_panel, q_screen, q_sources  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
