"""platewise: venue / menu search and moderation analytics on Spark.

Every public operator takes DataFrames (usually bundled in a
:class:`platewise.catalog.Catalog`) and returns a DataFrame.  The main path
is built-in Spark expressions so Catalyst can push filters, prune columns
and pick join strategies; no table is collected to the driver (a few
operators read back one number, e.g. a size or a "done?" check).
"""

from platewise.catalog import Catalog, LazyCatalog
from platewise.session import checkpoint_dir, get_spark, materialize

__all__ = ["Catalog", "LazyCatalog", "get_spark", "checkpoint_dir", "materialize"]
