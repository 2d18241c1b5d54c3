"""Panel time-series risk analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames keyed by ``panel_id`` so that one
job works on many panels at once.  See README.md for the scale rules that all
modules follow.
"""
