"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from tidemark.plans import facts, guidance, indexes, intake, ledger, market

MODULES = (market, guidance, indexes, ledger, intake, facts)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
