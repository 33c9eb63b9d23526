"""Column expressions shared by the operators; everything stays inside codegen."""
