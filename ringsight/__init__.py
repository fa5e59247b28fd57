"""Graph fraud features as PySpark DataFrame operators."""

from ringsight.graph import FraudGraph

__all__ = ["FraudGraph"]
