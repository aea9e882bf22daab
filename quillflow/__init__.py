"""quillflow: Spark-native building, auditing and scoring of text-evaluation data."""

__version__ = "0.1.0"
