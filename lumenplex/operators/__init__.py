"""DataFrame operators on stacks, codebooks, point clouds, tiles and rectangles."""
