"""End-to-end jobs composed from :mod:`cartlens.operators`."""
