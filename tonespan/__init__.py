"""Signal, span and timeline analytics as DataFrame-to-DataFrame functions."""
