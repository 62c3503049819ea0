"""Every registered query of the engine and its SQL."""

from __future__ import annotations

from tallyforge.plans import cleaning, decisions, grids, models, personas, sampling, texts, votes  # noqa: F401
from tallyforge.plans.declare import ORACLES, QUERIES  # noqa: F401
