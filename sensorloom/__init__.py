"""sensorloom: sensor-mesh telemetry analytics as Spark DataFrames."""
