"""The engine's programs: extract events, predict structure, discover motifs, simulate."""
