"""revlens: revenue-operations analytics as Spark DataFrame jobs.

Subpackages:

* ``sources``    - Parquet catalog, CRM views over the testdata, module registry,
  CSV ingestion and export.
* ``functions``  - column helpers (null/number rules, formats, dates) and phrase
  matching for text columns.
* ``operators``  - the analytics: aggregates, joins, trends, ranking, health,
  insights, documents, retrieval, question-log annotation, charts.
* ``plans``      - metric x dimension layer, distributed helpers, the registered
  queries and their DuckDB oracle SQL.
* ``streaming``  - question-log annotation as a Structured Streaming job.

Every public function takes DataFrames (or a session and paths) and returns
lazy DataFrames; nothing here starts a session except ``revlens.session``.
"""

__version__ = "0.1.0"
