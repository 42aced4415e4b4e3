"""All queries over the driver's tables, and the SQL they are held against."""

from __future__ import annotations

from graphloom.plans import graphs, linking, logs, retrieval, site

QUERIES = {**graphs.QUERIES, **retrieval.QUERIES, **linking.QUERIES, **logs.QUERIES, **site.QUERIES}
ORACLE_SQL: dict[str, str] = {**graphs.ORACLE_SQL, **retrieval.ORACLE_SQL, **linking.ORACLE_SQL, **logs.ORACLE_SQL, **site.ORACLE_SQL}
FLAGSHIP = "bm25_topk"
