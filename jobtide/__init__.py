"""jobtide: snapshot analytics over job postings, written for Spark.

Every public function takes and returns DataFrames (or Columns); nothing here
pulls a data set through the driver.  See the sub-packages:

* ``functions``  column expressions (text, dates, numbers, title rules)
* ``sources``    landed payloads and files -> typed posting frames
* ``operators``  identity, de-duplication, counts, trends, newness, quality
* ``sinks``      date-partitioned history, idempotent appends, rebuilds
* ``plans``      the composed analytics a dashboard or a weekly job calls
* ``streaming``  the same history kept up to date from a file stream
"""

__version__ = "0.1.0"
