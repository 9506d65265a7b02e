"""Column functions (``Column -> Column``): all built from Spark expressions, codegen-friendly."""

from abode.functions.scalars import *  # noqa: F401,F403
from abode.functions.bins import interval_bin, interval_bin_sql  # noqa: F401
