"""Text-triage and annotation analytics as DataFrame transformations."""
