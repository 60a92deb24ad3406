"""Column expressions: cleaning, dates, places, cycles, identity, boards."""
