"""skiffline: a Spark-first analytics engine for archived message channels."""

__version__ = "0.1.0"
