"""Sources, sinks and providers."""
