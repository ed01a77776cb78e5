"""quillgrid: document-corpus analytics as composable PySpark DataFrame operators."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
