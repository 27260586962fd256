"""All queries of the engine by name, and their SQL."""

from agrarium.plans import alignment, analytics, auditing, expressions, files, frames, history, mapping, monitoring, observations, packages, preparation, records, stores, streams  # noqa: F401
from agrarium.plans.registry import ORACLES, QUERIES  # noqa: F401
