"""grantmill: a PySpark engine for patent-grant archives and text corpora."""
