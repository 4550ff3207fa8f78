"""Product analytics over event logs, written as Spark DataFrame jobs.

Every operator takes DataFrames and returns a DataFrame; nothing runs until the
caller acts on it, except where a docstring says so.

Inputs used throughout:

* ``log``   -- ``user_id``, ``event`` string, ``ts`` timestamp, and optionally
  ``day``, the date the table is partitioned by (look-backs then prune it);
* ``users`` -- ``user_id`` (unique) and one string column per property.
"""
