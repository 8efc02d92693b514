"""Operations of a training-data pipeline, each a Spark job over whole tables.

Nothing outside this subpackage imports it. Every module holds one operator
with a general interface on DataFrames and the thin ``opN_<name>`` query that
applies it to the driver's tables with production parameters.
"""
