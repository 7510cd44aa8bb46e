"""Building blocks that steer execution: lineage, components, registered queries."""
