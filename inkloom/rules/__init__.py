"""Rule tables of the reading of dialogue: fixed values, as text."""
