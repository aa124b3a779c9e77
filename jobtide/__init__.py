"""Analytics over batch-job and cluster telemetry, written as Spark DataFrame operators."""
