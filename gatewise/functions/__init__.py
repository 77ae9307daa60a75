"""Column functions: no actions, no Python on executors."""
