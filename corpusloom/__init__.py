"""corpusloom: prepare file corpora held in tables of (repo, path, content)."""
