"""Scalar column functions. All are compositions of Spark built-ins."""
