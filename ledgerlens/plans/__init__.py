"""The analyses, one function per result set, and their registry."""
