"""Sources and sinks: CSV scans, layer tables with batch replacement, fixtures."""
