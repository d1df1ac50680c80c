"""farebox: ride-booking analytics as Spark DataFrame jobs.

Subpackages: ``functions`` (column expressions), ``sources`` (scans, layer
tables, fixtures), ``operators`` (the data operators), ``plans`` (physical
layouts and plan reports), ``streaming`` (Structured Streaming jobs).
``catalog`` registers every operator as a query with its DuckDB oracle.
"""

__version__ = "0.1.0"
