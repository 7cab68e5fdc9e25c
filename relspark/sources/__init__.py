"""Tables: the persistent catalog, its Parquet tables, and outside Parquet."""

from relspark.sources.catalog import Catalog
from relspark.sources.table import Table

__all__ = ["Catalog", "Table"]
