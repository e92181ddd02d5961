"""Types and scalar helpers of the dialect."""
