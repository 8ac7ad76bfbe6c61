"""flowloom: analytics over network flow records, written as Spark DataFrame jobs.

Every public operator is a function from DataFrame to DataFrame.  Nothing is
executed until the caller runs an action, except where a docstring says so
(iterative walks checkpoint their state, the build guard reads one row).
"""

__version__ = "0.1.0"
