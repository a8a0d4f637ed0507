"""sluice: declarative data pipelines run as Spark DataFrame and Structured Streaming jobs.

Sub-packages:

* ``sources``   - config discovery/parsing, declared source reads, metadata table scans
* ``functions`` - column-expression builders (types, strings, paths, JSON, nested sanitize)
* ``operators`` - column mapping, data-quality rules, audits, reconciliation joins, upsert
* ``sinks``     - table writes (append, overwrite, bucketed upsert store)
* ``plans``     - pipeline runner, config-ingestion job, inventory and deploy plan
* ``streaming`` - the same stages on streams (append, micro-batch upsert)
"""

from sluice.session import build_session, scratch_root

__all__ = ["build_session", "scratch_root"]
