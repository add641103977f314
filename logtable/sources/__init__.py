"""Readers. Each ``read_*`` scans files; its ``parse_*`` takes numbered lines."""
