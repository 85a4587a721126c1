"""Part of the stillhouse engine."""
