"""All queries of the core and their SQL."""

from __future__ import annotations

from paperweir.plans import fields, library, timestamps  # noqa: F401  fields registers with library

QUERIES = library.QUERIES | timestamps.QUERIES
SQL = library.SQL | timestamps.SQL
