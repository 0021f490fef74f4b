"""Column functions: identifiers, clocks, numbers, recodes and geometry."""
