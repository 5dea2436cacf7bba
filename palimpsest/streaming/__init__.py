"""Extension: files are audited as they arrive."""
