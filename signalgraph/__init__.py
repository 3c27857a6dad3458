"""Log analytics and anomaly detection as Spark DataFrame operators."""

from signalgraph.params import Params

__all__ = ["Params"]
