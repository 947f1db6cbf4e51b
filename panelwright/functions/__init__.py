"""Column expressions: recodes, formatting and distribution tails."""
