"""Queries of the sensor-fleet operators, with the SQL that checks them."""

from __future__ import annotations

from . import basic, checks, decisions, moving, streamed, windowed

MODULES = (basic, windowed, decisions, moving, checks, streamed)


def queries():
    return {name: q for module in MODULES for name, q in module.Q.items()}


def oracle_sql():
    return {name: q for module in MODULES for name, q in module.S.items()}
