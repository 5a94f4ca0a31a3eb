"""All queries of the core library, and the SQL that they are checked against."""

from __future__ import annotations

from stemline.plans import divisions, lineage, problems, relational, scores

PLANS = (problems, lineage, divisions, scores, relational)
QUERIES = {name: f for p in PLANS for name, f in p.QUERIES.items()}
SQL = {name: text for p in PLANS for name, text in p.SQL.items()}
FLAGSHIP = "score_report"
