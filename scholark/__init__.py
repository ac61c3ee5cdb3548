"""scholark: scholarly-collaboration analytics written for Spark.

Every operator takes DataFrames and returns a DataFrame; nothing is collected to the driver except values whose
size is bounded by a parameter (convergence counters, scaler bounds, model parameters).
"""

from scholark.corpus import Corpus
from scholark.session import build_session

__all__ = ["Corpus", "build_session"]
