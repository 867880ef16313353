"""Jobs composed of several operators: fitting, synthesis, trials, whole runs."""
