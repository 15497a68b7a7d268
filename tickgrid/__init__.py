"""Form-page checkbox analytics on Spark."""
