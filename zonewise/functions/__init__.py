"""Part of zonewise."""
