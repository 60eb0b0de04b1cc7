"""All queries over the given tables, by the operator ids of the survey, and their SQL."""

from __future__ import annotations

from . import answers, privacy, screening, state, wire  # noqa: F401
from .fixtures import ORACLE_SQL, QUERIES, query  # noqa: F401
