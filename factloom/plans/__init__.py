"""Rule tables and composed plans."""
