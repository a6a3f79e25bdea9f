"""sources of the gridloom engine."""
