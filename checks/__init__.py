"""Queries over the driver's tables, each with the same question in plain SQL."""

from checks.base import CHECKS, SQL  # noqa: F401
from checks import (anchor, evaluate, fields, grids, models, observations, physics, sinks, spatial)  # noqa: F401
