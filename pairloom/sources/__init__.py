"""Table schemas, scans, sinks and the views over the test tables."""
