"""The registered queries: one or more per operator, each over whole tables."""

from coppice.queries import evaluation, features, ingest, models, profiles, targets  # noqa: F401
from coppice.queries.base import REGISTERED

__all__ = ["REGISTERED"]
