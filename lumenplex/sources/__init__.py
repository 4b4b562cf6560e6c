"""Where stacks, codebooks and point clouds come from."""
