"""Plan-shaping helpers: global positions and prefix sums, one-row frames, written tables."""
