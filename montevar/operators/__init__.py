"""DataFrame -> DataFrame operators of the risk pipeline."""
