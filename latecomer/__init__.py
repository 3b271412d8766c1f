"""Late-arriving-data lakehouse operators on Spark DataFrames."""

from .dataset import Dataset, Lake, Run

__all__ = ["Dataset", "Lake", "Run"]
