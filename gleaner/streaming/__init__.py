"""The scheduled run as a stream of arriving files."""
