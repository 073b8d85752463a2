"""News documents to entity timelines, as Spark DataFrame jobs.

Packages: ``functions`` (column expressions), ``operators`` (relational
building blocks), ``sources`` (readers and sinks), ``plans`` (whole jobs and
serving queries), ``streaming`` (Structured Streaming jobs) and ``queries``
(the registered queries with their check SQL).
"""

__version__ = "0.1.0"
