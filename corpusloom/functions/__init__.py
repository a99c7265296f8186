"""Part of corpusloom; see README.md."""
