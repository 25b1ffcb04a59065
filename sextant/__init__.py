"""Point-in-time market analytics on Spark.

Relations are long DataFrames (one row per session and symbol); missing values are NULL. `sources` reads vendor files and
adapts tables, `operators` holds joins, panels, windows, statistics and engines, `functions` holds column builders,
`plans` the research log and its decisions, `streaming` the extensions over streams, `registry` the registered queries.
"""
