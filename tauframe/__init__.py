"""tauframe: treatment-effect and targeting analytics on Spark DataFrames."""

from tauframe.spec import CausalSpec

__all__ = ["CausalSpec"]
