"""opinio: comment analytics on Spark DataFrames.

Every public operator is a ``DataFrame -> DataFrame`` function (or a
``Column -> Column`` expression builder) made of built-in Spark SQL
expressions, joins, aggregates, windows and Spark ML stages.
"""

from opinio.session import get_session, work_dir

__all__ = ["get_session", "work_dir"]
