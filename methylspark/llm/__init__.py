"""Training-data pipeline operators (tokenisation, archives, scans, deduplication, filtering)."""
