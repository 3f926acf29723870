"""Registered queries of the ticket operators and the SQL each is compared with."""

from __future__ import annotations

from . import q_recurrence, q_text, q_tickets  # noqa: F401
from .bindings import profiles
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    """Profiles of recurring events, with their measures."""
    return profiles(spark, sf_dir)
