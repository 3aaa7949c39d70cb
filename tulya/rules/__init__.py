"""Values that results depend on."""
