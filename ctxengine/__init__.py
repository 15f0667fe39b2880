"""ctxengine: corpus and context preparation on PySpark."""

__version__ = "0.1.0"
