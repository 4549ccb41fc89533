"""quarry: declarative data checks, feature transforms, metrics, series operators and model search on PySpark."""

__version__ = "0.1.0"
