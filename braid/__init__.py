"""braid: workflow-style dataflow analytics as set-oriented Spark queries."""

__version__ = "0.1.0"
