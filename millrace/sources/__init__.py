from millrace.sources.tables import read

__all__ = ["read"]
