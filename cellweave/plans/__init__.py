"""Plan parts that several operators use: durable tables, global ranks, components, tiles."""
