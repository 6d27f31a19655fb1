"""Registered queries: each operator over the whole of the given tables."""

from __future__ import annotations

from faultlens.queries import (  # noqa: F401
    evaluation,
    features,
    fleet,
    history,
    io,
    labels,
    models,
    profiles,
    sampling,
    scalars,
    streams,
    windows,
)
from faultlens.queries.registry import REGISTRY

__all__ = ["REGISTRY"]
