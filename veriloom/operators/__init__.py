"""DataFrame operators: lazy, and free of driver-side actions."""
