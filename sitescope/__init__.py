"""sitescope — land-suitability analytics as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` (or returns a small
metrics DataFrame) built from Spark SQL expressions and MLlib; nothing is
collected to the driver beyond single metric rows.
"""

__version__ = "0.1.0"
