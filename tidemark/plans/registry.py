"""All queries by name and their SQL."""

from __future__ import annotations

from . import backtest, basic, landing, study  # noqa: F401  importing a module registers its queries
from .bindings import dates_as_text

QUERIES: dict = dict(basic.QUERIES)
ORACLES: dict = {}
for _name, _sql in basic.ORACLES.items():
    while "\n,\n" in _sql or "\n," in _sql:
        _sql = _sql.replace("\n,", ",")
    ORACLES[_name] = dates_as_text(_sql, basic.DATES.get(_name, ""))
