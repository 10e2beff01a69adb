"""All registered queries.  Importing the topic modules fills the registry."""

from __future__ import annotations

from adlift.plans import evaluation, explanation, modeling, preparation, profiling, scoring  # noqa: F401
from adlift.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
