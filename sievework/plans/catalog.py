"""All queries and oracles of the library."""

from . import claims, dossier, evidence, ledger, filings, metrics, pages, synthesis, sync

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (evidence, ledger, dossier, claims, metrics, sync, pages, filings, synthesis):
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
