"""muniscope: evidence-led public-works analytics expressed as Spark plans."""

__version__ = "0.1.0"
