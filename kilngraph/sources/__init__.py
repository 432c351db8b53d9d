"""Sources, sinks and configuration."""
