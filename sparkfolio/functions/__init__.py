"""Column functions: no shuffles, all inside whole-stage code generation."""
