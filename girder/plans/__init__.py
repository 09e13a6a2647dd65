"""Sessions, tables with their guards, and the registered queries."""
