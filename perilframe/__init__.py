"""perilframe: physical-climate risk and total cost of risk as Spark DataFrame operators."""

__version__ = "0.1.0"
