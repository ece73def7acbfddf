"""All registered queries with the SQL that states the same result."""

from . import alerting, alerts, detection, ingest, reports

_parts = (detection, reports, ingest, alerts, alerting)

QUERIES: dict = {k: v for p in _parts for k, v in p.QUERIES.items()}
ORACLE: dict = {k: v for p in _parts for k, v in p.ORACLE.items()}

#: Queries that SQL cannot say: ordered folds.  Their tests compare with plain code.
FOLDS = {k for p in _parts for k in getattr(p, "FOLDS", ())}
