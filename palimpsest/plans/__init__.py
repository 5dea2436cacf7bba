"""From tables to reports: which detectors run, and what a corpus scan is."""
