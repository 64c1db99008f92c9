"""NumPy kernels without Spark: finite field, codes, frames, alignment, channel."""
