"""Registered queries over the sample tables, each with its SQL check."""

from __future__ import annotations

import importlib

AREAS = ("frames", "scalars", "profiles", "movement", "corpora", "workflow")


def load_all() -> None:
    """Import every area, which registers its queries."""
    for area in AREAS:
        importlib.import_module(f"tablesmith.plans.{area}")
