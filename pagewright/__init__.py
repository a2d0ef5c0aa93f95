"""pagewright: document segmentation and sentence enrichment on Spark."""

__version__ = "0.1.0"
