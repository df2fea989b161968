"""streamwatch: event-stream monitoring jobs as PySpark DataFrame functions.

Subpackages: ``sources`` (logs, test tables, Kafka, sinks), ``functions``
(event time, panes, time buckets), ``operators`` (windows, top-N, patterns,
joins, blacklist, rise alarm, split), ``streaming`` (watermarked and stateful
stream forms) and ``plans`` (the jobs bound to the test tables, with their
SQL oracles).
"""

__version__ = "0.1.0"
