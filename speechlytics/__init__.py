"""speechlytics: analytics over speech-to-text evaluations, declared on Spark DataFrames."""

__version__ = "0.1.0"
