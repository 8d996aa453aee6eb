"""Part of spectrafold; see the README."""
