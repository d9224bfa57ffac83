"""harrow: agronomic analytics as PySpark DataFrame transformations.

Sub-packages
------------
functions   ``Column`` expressions (dates, geography, climate, features, indices)
operators   ``DataFrame -> DataFrame`` jobs (cleaning, joins, aggregates, quality, models)
sources     readers and writers
plans       multi-step jobs built from the operators (survey features, climate export, training)
streaming   the row-wise operators applied to file streams
catalog     the registered queries and their SQL counterparts
"""
