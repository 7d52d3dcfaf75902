"""Registered queries over the given tables, one per operator, each with oracle SQL where SQL can say it."""

from leadspark.catalog import jobs, layouts, quality, tables, values  # noqa: F401
from leadspark.catalog.base import QUERIES  # noqa: F401
