"""cairnmesh: gridded-habitat connectivity analytics on Spark DataFrames.

Sub-packages: ``sources`` (tables in, tables out), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame), ``plans`` (composites),
``streaming`` (what has an incremental form).
"""
