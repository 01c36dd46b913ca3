"""Registry of detectors, sweeps, benchmark runs and leaderboards."""
