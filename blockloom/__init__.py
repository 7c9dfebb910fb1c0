"""Blockchain data as Spark tables and streams.

``functions``   column expressions (ids, checks, text, ordering)
``sources``     scans: pinned files, prefixes, JSON Lines batches, hot + cold union
``operators``   DataFrame -> DataFrame transforms: filters, joins, aggregates, windows, ranges
``sinks``       replay-safe writes, committed scopes, version registry, compaction
``plans``       read-only SQL, user rules, incremental runs, dependency closure
``streaming``   Structured Streaming jobs built from the same operators
``workloads``   chain-shaped views over the benchmark tables and the registered queries
"""

__version__ = "0.1.0"
