"""Outbreak-risk analytics expressed as Spark DataFrame jobs."""

from contagia.params import FederatedParams, RunParams

__all__ = ["FederatedParams", "RunParams"]
