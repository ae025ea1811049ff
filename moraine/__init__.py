"""moraine: clustering, summarising and curating large tables, natively on PySpark."""

__version__ = "0.1.0"
