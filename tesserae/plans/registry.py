"""All queries of the library outside the training-data subpackage, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from tesserae.plans import adjudication, curation, evaluation, features  # noqa: F401  each registers its queries
from tesserae.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
