"""Analytics on Spark for sessions of interval events, frame-sampled features and point processes."""
