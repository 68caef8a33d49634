"""Sources, sinks and the adapters that shape the driver tables."""
