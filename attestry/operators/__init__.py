"""Jobs over tables, by the kind of table they read."""
