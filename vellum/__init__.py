"""vellum: a semantic library of web pages and texts, built as Spark DataFrame jobs.

Every public function takes and returns DataFrames or Columns; nothing is
collected to the driver except bounded, size-checked query matrices.
"""

__version__ = "0.1.0"
