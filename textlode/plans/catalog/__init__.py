"""The registered queries: every operator on the given tables, with equal SQL where SQL can say it."""

from textlode.plans.catalog import (  # noqa: F401
    classifiers,
    neighbours,
    pairs,
    profiles,
    quality,
    reading,
    runs,
    sampling,
    texts,
    vectors,
)
from textlode.plans.catalog.registry import ORACLES, QUERIES  # noqa: F401
