"""Multi-step flows and the registered queries."""
