"""Column functions: rotations, geodesy and scalars."""
