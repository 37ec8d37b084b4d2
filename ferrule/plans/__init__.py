"""What is decided before numbers are touched: costs, partitions, and the solver that runs the plan."""
