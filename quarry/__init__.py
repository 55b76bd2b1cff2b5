"""quarry: retrieval, ingest and analytics over large text corpora, declared as Spark DataFrames."""

__all__ = ["session"]
