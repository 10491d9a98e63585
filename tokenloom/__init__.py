"""Agent-context analytics as Spark jobs: session logs in, context accounting out."""

__version__ = "0.1.0"
