"""rankwell."""
