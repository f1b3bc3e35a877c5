"""Column helpers: identifiers, units, time grids, rules and the t distribution."""
