"""driftengine: drift analytics over sequences and metric vectors, as Spark jobs."""

__version__ = "0.1.0"
