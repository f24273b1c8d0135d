"""File scans and result sinks."""
