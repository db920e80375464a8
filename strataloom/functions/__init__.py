"""Column builders: text, markup, naming and run-log functions as Catalyst expressions."""
