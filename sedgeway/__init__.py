"""sedgeway: file-metadata search, change capture and recovery analytics on PySpark."""

__version__ = "0.1.0"
