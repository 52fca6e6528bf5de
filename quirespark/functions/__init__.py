"""Part of quirespark; see the README for the map of modules."""
