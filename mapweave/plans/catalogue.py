"""Every query of the engine over the supplied tables, with the SQL that gives the same rows."""

from __future__ import annotations

from mapweave.plans import label_plans, study_plans, vector_plans  # noqa: F401
from mapweave.plans.registry import ORACLES, QUERIES  # noqa: F401
