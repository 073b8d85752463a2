"""Column expressions; built-in functions unless the docstring says otherwise."""
