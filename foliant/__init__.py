"""foliant: preparing, chunking, mixing and scoring long-document corpora on Spark."""

__version__ = "0.1.0"
