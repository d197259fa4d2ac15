"""vlprep: preparing and evaluating image-text training data on Spark."""

__version__ = "0.1.0"
