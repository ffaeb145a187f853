"""Analytics over line-and-arc drawings, and over text collections, on Spark."""
