"""Event counting over streams of mapped reads."""
