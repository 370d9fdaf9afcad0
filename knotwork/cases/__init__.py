"""Cases: from reports, registers, call records and address books to a graph with evidence, and what can be read off it."""
