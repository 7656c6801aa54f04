"""DataFrame operators: preparation, patches, statistics, kernels, projection, channels."""
