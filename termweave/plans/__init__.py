"""The operators composed into whole jobs."""
