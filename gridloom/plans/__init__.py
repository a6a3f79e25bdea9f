"""plans of the gridloom engine."""
