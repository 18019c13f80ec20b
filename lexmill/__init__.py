"""lexmill: DataFrame operators for building, cleaning, splitting, profiling and evaluating text corpora on Spark."""

__version__ = "0.1.0"
