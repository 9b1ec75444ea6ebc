"""Column builders and model plug-ins."""
