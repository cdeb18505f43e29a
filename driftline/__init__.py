"""Moving-source analytics on Spark DataFrames.

Every operator takes and returns DataFrames keyed by ``build_id`` (one
sequence of exposures) or ``field_id`` (one quadrant-night), so one job
handles all builds at once.
"""
