"""operators of the gridloom engine."""
