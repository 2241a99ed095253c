"""rangeloom: byte-range, transfer-plan and run-log analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
