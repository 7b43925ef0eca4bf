"""thermoload: weather, grid-load and facility analytics as Spark DataFrame jobs.

Subpackages: ``sources`` (inputs and sinks), ``functions`` (column helpers),
``operators`` (the analytic steps), ``plans`` (registered queries, oracle,
end-to-end builds), ``streaming`` (incremental ingest).
"""

__version__ = "0.1.0"
