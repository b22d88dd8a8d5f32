"""Operators of a training-data pipeline.  Nothing else in the library imports
this subpackage; the queries over the given tables are in :mod:`.queries`."""
