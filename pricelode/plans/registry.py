"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("valuation", "history", "clean", "matching", "stream")


def queries() -> dict:
    out: dict = {}
    for group in GROUPS:
        out.update(import_module(f"pricelode.plans.{group}_queries").QUERIES)
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for group in GROUPS:
        out.update(import_module(f"pricelode.plans.{group}_sql").ORACLES)
    return out
