"""cloudloom: labelled 3-D point-cloud analytics expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
