"""shelfwise — retail analytics as plain Spark DataFrame jobs.

Every public function takes DataFrames (plus scalar parameters) and returns a
lazy DataFrame; nothing is collected to the driver.  Modules:

* ``sources``   — readers, writers and the star-schema adapter (retail tables)
* ``functions`` — shared column expressions (bands, calendar, safe division)
  and distributed statistics helpers (exact quantiles, ranks)
* ``operators`` — the analytics: demand, pricing, customers, recommendations,
  returns, fraud, fulfilment, merchandising, metrics
* ``plans``     — the query catalogue (one Spark plan + one SQL oracle per key)
* ``streaming`` — micro-batch drivers that apply batch operators to streams
"""

from shelfwise.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
