"""panelkit: panel analytics on Spark DataFrames.

Every operator is a function DataFrame -> DataFrame built from Catalyst
expressions, windows and aggregates; the few kernels that need a loop over a
short series run as Arrow-batched ``mapInPandas`` over a series table.
"""

__version__ = "0.1.0"
