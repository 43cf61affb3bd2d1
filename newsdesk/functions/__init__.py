"""Column functions: Column -> Column, in Catalyst expressions wherever they can say it."""
