"""The catalogue of ready queries over the driver's tables."""

from unionlog.plans.catalog import ORACLES, QUERIES  # noqa: F401
