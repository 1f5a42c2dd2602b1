"""Column functions over curriculum fields."""
