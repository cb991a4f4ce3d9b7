"""Queries of the engine; importing this package registers them in the catalog."""

from . import exports, fields, matching, precedence, reconcile, reports, scalars, scans  # noqa: F401
