"""The estimator, the hop loop and the step-by-step functions."""
